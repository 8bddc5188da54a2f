"""Search evaluation: run engines over a query set, judge, compute and report metrics."""

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.times import moment
from shelfmark.operators.catalog import fresh_schema_ids, signal_of
from shelfmark.plans.dense import HashingEmbedder, embedding_column, search_dense_batch
from shelfmark.plans.search import TermIndex, search_bm25_batch, search_tokens_batch
from shelfmark.schemas import conform

METRICS = ["precision", "recall", "f1", "mrr", "ap", "ndcg"]


@dataclass(frozen=True)
class EngineTables:
    """What the engines search."""

    datasets: DataFrame
    artifacts: DataFrame
    corpus: DataFrame | None = None
    index: TermIndex | None = None
    vectors: DataFrame | None = None
    embedder: object = field(default_factory=HashingEmbedder)


def _present(ranked: DataFrame, tables: EngineTables, with_score: bool) -> DataFrame:
    """Ranked ids with title and a JSON summary of each hit."""
    facts = tables.datasets.select(
        F.col("id").alias("dataset_id"), "title",
        F.substring(F.coalesce("description", F.lit("")), 1, C.SNIPPET_CHARS).alias("description"),
        "license_class", "size_class",
        F.coalesce("modalities", F.array().cast("array<string>")).alias("modalities"),
        signal_of("downloads").alias("downloads"), signal_of("likes").alias("likes"),
    )
    fresh = fresh_schema_ids(tables.artifacts).withColumn("_fresh", F.lit(True))
    joined = ranked.join(facts, "dataset_id").join(fresh, "dataset_id", "left")
    shown = joined.withColumn("has_schema", F.col("_fresh").isNotNull())
    names = ["description", "license_class", "size_class", "modalities", "has_schema", "downloads", "likes"]
    extra = F.to_json(F.struct(*names, *(["score"] if with_score else [])), {"ignoreNullFields": "false"})
    return shown.select("query_id", "rank", "dataset_id", "title", extra.alias("extra"))


def run_token_hits(tables: EngineTables, queries: DataFrame, k: int) -> DataFrame:
    return _present(search_tokens_batch(tables.corpus, tables.datasets, queries, k), tables, False)


def run_bm25(tables: EngineTables, queries: DataFrame, k: int) -> DataFrame:
    return _present(search_bm25_batch(tables.index, tables.datasets, queries, k), tables, False)


def run_dense(tables: EngineTables, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.select("query_id", embedding_column(tables.embedder, "query").alias("vector"))
    return _present(search_dense_batch(tables.vectors, tables.datasets, asked, k), tables, True)


# An engine takes all queries (query_id, query) at once and returns
# (query_id, rank, dataset_id, title, extra).
Engine = Callable[[EngineTables, DataFrame, int], DataFrame]
ENGINES: dict[str, Engine] = {"token_hits": run_token_hits, "bm25": run_bm25, "dense": run_dense}


def seed_queries(spark: SparkSession, as_of: Column | datetime | str | None = None) -> DataFrame:
    """The query set to start from."""
    rows = spark.createDataFrame(
        C.SEED_EVAL_QUERIES, "id string, label string, query string, target_id string, total_relevant int"
    )
    return conform(rows.withColumn("active", F.lit(True)).withColumn("created_at", moment(as_of)), "eval_queries")


def list_queries(queries: DataFrame, active_only: bool = True) -> DataFrame:
    return (queries.filter("active") if active_only else queries).orderBy("id")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").asc())


def run_eval(
    engine: str,
    tables: EngineTables,
    queries: DataFrame,
    k: int = C.EVAL_K_DEFAULT,
    label: str = "",
    as_of: Column | datetime | str | None = None,
    run_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(run row, result rows) of every active query through one engine."""
    if engine not in ENGINES:
        raise ValueError(f"no engine {engine!r}; there are {', '.join(sorted(ENGINES))}")
    if not 1 <= k <= C.EVAL_K_MAX:
        raise ValueError(f"k must be from 1 to {C.EVAL_K_MAX}")
    run_id = run_id or str(uuid4())
    asked = queries.filter("active").select(F.col("id").alias("query_id"), "query")
    hits = ENGINES[engine](tables, asked, k)
    results = conform(
        hits.withColumn("run_id", F.lit(run_id)).withColumnRenamed("rank", "result_rank"), "eval_run_results"
    )
    spark = queries.sparkSession
    run = spark.range(1).select(
        F.lit(run_id).alias("id"), F.lit(label).alias("label"), F.lit(engine).alias("engine"),
        F.lit(k).alias("k"), moment(as_of).alias("created_at"),
    )
    return conform(run, "eval_runs"), results


def asked_queries(run_id: str, queries: DataFrame) -> DataFrame:
    """(run_id, query_id) of the queries a run puts to its engine, hits or not."""
    return queries.filter("active").select(F.lit(run_id).alias("run_id"), F.col("id").alias("query_id"))


def judged_results(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Run results with the judgment of each hit, NULL where nobody judged."""
    marks = judgments.select("query_id", "dataset_id", "relevant")
    return results.join(marks, ["query_id", "dataset_id"], "left")


def _total_relevant() -> Column:
    given = F.col("total_relevant")
    return F.when(given.isNull() | (given == 0), F.lit(1)).otherwise(given)


def _ranked(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judged hits with place, relevance and running count of relevant hits per run and query.

    A run keeps at most 50 hits per query (see run_eval), which bounds the window.
    """
    ordered = Window.partitionBy("run_id", "query_id").orderBy("result_rank")
    prefix = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = judged_results(results, judgments).withColumn("rel", F.expr("if(coalesce(relevant, false), 1, 0)"))
    return rows.withColumns({"place": F.row_number().over(ordered), "cum": F.sum("rel").over(prefix)})


_TERMS = {
    "p_at": "cum / place",
    "ap_term": "rel * cum / place",
    "dcg_term": "rel / log2(place + 1D)",
}


def report_rows(results: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """Per hit: judgment, running count of relevant hits and its terms of AP, DCG and ideal DCG."""
    totals = queries.select(F.col("id").alias("query_id"), _total_relevant().alias("total_relevant"))
    rows = _ranked(results, judgments).join(totals, "query_id", "left")
    return rows.selectExpr(
        "run_id", "query_id", "result_rank", "place", "dataset_id", "title", "extra", "relevant", "rel", "cum",
        *[f"{sql} as {name}" for name, sql in _TERMS.items()],
        "if(place <= coalesce(total_relevant, 1), 1 / log2(place + 1D), 0D) as idcg_term",
    )


def query_metrics(
    results: DataFrame,
    judgments: DataFrame,
    queries: DataFrame,
    runs: DataFrame,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Precision, recall, F1, MRR, AP and nDCG at k per run and query.

    A query without hits leaves no rows and so no metrics. With ``asked`` (see
    asked_queries) such queries count with zeros.
    """
    sums = _ranked(results, judgments).groupBy("run_id", "query_id").agg(
        F.count("*").alias("n_results"),
        F.sum("rel").alias("found"),
        F.expr("min(if(rel = 1, place, null))").alias("first_rank"),
        F.expr(f"sum({_TERMS['ap_term']})").alias("ap_sum"),
        F.expr(f"sum({_TERMS['dcg_term']})").alias("dcg"),
    )
    if asked is not None:
        sums = asked.select("run_id", "query_id").join(sums, ["run_id", "query_id"], "full_outer")
    config = queries.select(
        F.col("id").alias("query_id"), "label", "query", _total_relevant().alias("total_relevant")
    )
    joined = sums.join(config, "query_id", "left").join(runs.select(F.col("id").alias("run_id"), "k"), "run_id")
    base = joined.selectExpr(
        "run_id", "query_id", "k", "found", "first_rank", "ap_sum", "dcg",
        "coalesce(label, '') as label", "coalesce(query, '') as query",
        "coalesce(total_relevant, 1) as total_relevant", "coalesce(n_results, 0) as n_results",
    ).selectExpr(
        "*",
        "n_results > 0 and total_relevant > 0 as counts",
        # The best ranking has its relevant hits on top; at most 50 places.
        """if(n_results > 0 and total_relevant > 0,
              aggregate(sequence(1L, least(n_results, bigint(total_relevant))), 0D, (sum, i) -> sum + 1 / log2(i + 1D)), 0D) as idcg""",
    )
    measured = base.selectExpr(
        "run_id", "query_id", "label", "query", "total_relevant", "n_results",
        "if(counts and k > 0, found / k, 0D) as precision",
        "if(counts, found / total_relevant, 0D) as recall",
        "if(counts, coalesce(1 / first_rank, 0D), 0D) as mrr",
        "if(counts, ap_sum / total_relevant, 0D) as ap",
        "if(counts and idcg > 0, dcg / idcg, 0D) as ndcg",
    )
    return measured.withColumn(
        "f1", F.expr("if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0D)")
    )


def run_summaries(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """All runs with their mean metrics (mean AP is ``map``), newest first."""
    means = metrics.groupBy("run_id").agg(
        F.avg("ap").alias("map"),
        *[F.avg(m).alias(f"mean_{m}") for m in ("mrr", "ndcg", "precision", "recall", "f1")],
    )
    names = ["map", "mean_mrr", "mean_ndcg", "mean_precision", "mean_recall", "mean_f1"]
    joined = runs.join(means, runs["id"] == means["run_id"], "left")
    shown = joined.select("id", "label", "engine", "k", "created_at", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return shown.orderBy(F.col("created_at").desc(), F.col("id").asc())


def run_detail(results: DataFrame, metrics: DataFrame, run_id: str) -> DataFrame:
    """Metrics of one run's queries, by query id."""
    return metrics.filter(F.col("run_id") == run_id).orderBy("query_id")


def summary_with_mean(metrics: DataFrame) -> DataFrame:
    """Metrics per run and query, and a MEAN row per run, in one aggregation."""
    keys = ["run_id", "query_id", "label"]
    sets = metrics.groupingSets([[F.col(k) for k in keys], [F.col("run_id")]], *keys)
    rows = sets.agg(F.grouping("query_id").alias("_mean"), *[F.avg(m).alias(m) for m in METRICS])
    return rows.select(
        "run_id",
        F.when(F.col("_mean") == 1, "MEAN").otherwise(F.col("query_id")).alias("query_id"),
        F.when(F.col("_mean") == 1, "mean of all queries").otherwise(F.col("label")).alias("label"),
        *METRICS,
    )


def query_sheet(results: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """The per-query sheet of a report: the hits, how they were judged, and the metric terms."""
    rows = report_rows(results, judgments, queries)

    def shown(name: str) -> Column:
        return F.get_json_object("extra", f"$.{name}")

    mods = F.from_json(shown("modalities"), "array<string>")
    return rows.select(
        "run_id", "query_id", F.col("result_rank").alias("rank"), "dataset_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(shown("size_class"), F.lit("")).alias("size_class"),
        F.coalesce(F.array_join(mods, ", "), F.lit("")).alias("modalities"),
        shown("downloads").try_cast("bigint").alias("downloads"),
        shown("likes").try_cast("bigint").alias("likes"),
        F.when(F.col("relevant"), "yes").when(~F.col("relevant"), "no").otherwise("").alias("judged"),
        "rel", "cum", "p_at", "ap_term", "dcg_term", "idcg_term",
    )
