"""Search evaluation and signal-log queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark import views as V
from shelfmark.operators import keyed as K
from shelfmark.operators.catalog import search_corpus
from shelfmark.plans import evaluation as E
from shelfmark.plans.search import build_term_index
from shelfmark.schemas import conform
from shelfmark.streaming.streams import windowed_signal_counts
from shelfmark.workload.registry import ARTIFACTS, DATASETS, SIGNALS, query
from shelfmark.workload.search import _BATCH_TOP, _BENCH_TERMS, _BENCH_TOKENS, _POSTINGS, _bm25


# A query stands for a user in a stretch of events, so that lists stay short however many events there are.
_ASKED = "concat('u', user_id, '.', event_id div 5000)"


def results(spark, folder, floor=None):
    """Events as run results: a run per event type, and every event a hit of its query.

    An engine with a floor returns nothing below that value.
    """
    events = V.table(spark, folder, "events")
    if floor is not None:
        events = events.filter(F.col("value") >= floor)
    events = events.withColumn("query_id", F.expr(_ASKED))
    order = Window.partitionBy("event_type", "query_id").orderBy(F.col("value").desc(), "event_id")
    ranked = events.withColumn("result_rank", F.row_number().over(order))
    return conform(
        ranked.selectExpr(
            "event_type as run_id", "query_id", "result_rank",
            "get_json_object(props, '$.k') as dataset_id", "event_type as title",
            """concat('{"size_class":"n<1K","modalities":["text","image"],"downloads":', event_id, '}') as extra""",
        ),
        "eval_run_results",
    )


def judgments(spark, folder):
    """What was viewed or clicked counts as judged, and as relevant if its value was high."""
    seen = V.table(spark, folder, "events").filter("event_type in ('view', 'click')")
    marks = seen.selectExpr(f"{_ASKED} as query_id", "get_json_object(props, '$.k') as dataset_id", "value")
    return conform(
        marks.groupBy("query_id", "dataset_id").agg((F.max("value") > 20).alias("relevant")), "eval_judgments"
    )


def questions(spark, folder):
    users = V.table(spark, folder, "events").select("user_id", F.expr(_ASKED).alias("query_id")).distinct()
    return conform(
        users.selectExpr(
            "query_id as id", "'user' as label", "concat('about ', user_id) as query",
            "cast(user_id % 5 as int) as total_relevant", "true as active",
        ),
        "eval_queries",
    )


def runs(spark, folder):
    kinds = V.table(spark, folder, "events").groupBy("event_type").agg(F.min("ts").alias("created_at"))
    return conform(
        kinds.selectExpr("event_type as id", "concat('run ', event_type) as label", "'bm25' as engine", "10 as k", "created_at"),
        "eval_runs",
    )


_EVAL = """
ev AS (SELECT *, 'u' || user_id || '.' || (event_id // 5000) AS query_id, json_extract_string(props, '$.k') AS dataset_id FROM events),
results AS (
  SELECT event_type AS run_id, query_id, user_id, event_id, dataset_id,
         row_number() OVER (PARTITION BY event_type, query_id ORDER BY value DESC, event_id) AS i FROM ev),
judgments AS (SELECT query_id, dataset_id, max(value) > 20 AS relevant FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL),
terms AS (
  SELECT r.*, j.relevant, CASE WHEN coalesce(relevant, false) THEN 1 ELSE 0 END AS rel,
         CASE WHEN user_id % 5 = 0 THEN 1 ELSE user_id % 5 END AS total
  FROM results r LEFT JOIN judgments j ON j.query_id = r.query_id AND j.dataset_id = r.dataset_id),
sheet AS (
  SELECT *, sum(rel) OVER (PARTITION BY run_id, query_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM terms),
sums AS (
  SELECT run_id, query_id, user_id, total, sum(rel) AS found, min(CASE WHEN rel = 1 THEN i END) AS first,
         sum(rel * cum / i) AS ap_sum, sum(rel / log2(i + 1)) AS dcg,
         sum(CASE WHEN i <= total THEN 1 / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS n
  FROM sheet GROUP BY ALL),
metrics AS (
  SELECT run_id, query_id, 'user' AS label, 'about ' || user_id AS query, total AS total_relevant, n AS n_results,
         found / 10 AS precision, found / total AS recall, coalesce(1.0 / first, 0) AS mrr, ap_sum / total AS ap,
         dcg / idcg AS ndcg,
         CASE WHEN found > 0 THEN 2 * (found / 10) * (found / total) / (found / 10 + found / total) ELSE 0 END AS f1
  FROM sums)"""
_ROUNDED = ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in E.METRICS)


def _metrics(spark, folder):
    return E.query_metrics(
        results(spark, folder), judgments(spark, folder), questions(spark, folder), runs(spark, folder)
    )


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("eval_metrics", f"""WITH {_EVAL} SELECT run_id, query_id, label, query, CAST(total_relevant AS INTEGER) AS total_relevant,
n_results, {_ROUNDED} FROM metrics""")
def eval_metrics(spark, folder):
    return _rounded(_metrics(spark, folder), E.METRICS)


@query(
    "eval_metrics_with_empty",
    f"""WITH {_EVAL.replace("AS i FROM ev)", "AS i FROM ev WHERE value >= 60)")},
    asked AS (SELECT DISTINCT event_type AS run_id, query_id FROM ev)
    SELECT run_id, query_id, coalesce(n_results, 0) AS n_results,
           {", ".join(f"round(CAST(coalesce({m}, 0) AS DOUBLE), 6) AS {m}" for m in E.METRICS)}
    FROM asked LEFT JOIN metrics USING (run_id, query_id)""",
)
def eval_metrics_with_empty(spark, folder):
    """Metrics of an engine that finds nothing for some of the queries put to it."""
    asked = V.table(spark, folder, "events").selectExpr(
        "event_type as run_id", f"{_ASKED} as query_id"
    ).distinct()
    metrics = E.query_metrics(
        results(spark, folder, floor=60), judgments(spark, folder), questions(spark, folder), runs(spark, folder), asked
    )
    return _rounded(metrics, E.METRICS).select("run_id", "query_id", "n_results", *E.METRICS)


_MEANS = "avg(ap) AS map, " + ", ".join(f"avg({m}) AS mean_{m}" for m in E.METRICS if m != "ap")
_MEAN_NAMES = ["map"] + [f"mean_{m}" for m in E.METRICS if m != "ap"]


@query("eval_run_history", f"""WITH {_EVAL}, means AS (SELECT run_id, {_MEANS} FROM metrics GROUP BY 1),
runs AS (SELECT event_type AS id, min(ts) AS created_at FROM events GROUP BY 1)
SELECT id, 'run ' || id AS label, 'bm25' AS engine, 10 AS k, epoch_us(created_at) AS created_at,
       {", ".join(f"round({m}, 6) AS {m}" for m in _MEAN_NAMES)}
FROM runs JOIN means ON run_id = id""")
def eval_run_history(spark, folder):
    summaries = E.run_summaries(runs(spark, folder), _metrics(spark, folder))
    return _rounded(summaries, _MEAN_NAMES).withColumn("created_at", F.unix_micros("created_at"))


@query("eval_report_rows", f"""WITH {_EVAL}
SELECT run_id, query_id, CAST(i AS INTEGER) AS rank, dataset_id, run_id AS title, 'n<1K' AS size_class, 'text, image' AS modalities,
       event_id AS downloads, CAST(NULL AS BIGINT) AS likes,
       CASE WHEN relevant THEN 'yes' WHEN NOT relevant THEN 'no' ELSE '' END AS judged, rel, CAST(cum AS BIGINT) AS cum,
       round(cum / i, 6) AS p_at, round(rel * cum / i, 6) AS ap_term, round(rel / log2(i + 1), 6) AS dcg_term,
       round(CASE WHEN i <= total THEN 1 / log2(i + 1) ELSE 0 END, 6) AS idcg_term
FROM sheet""")
def eval_report_rows(spark, folder):
    sheet = E.query_sheet(results(spark, folder), judgments(spark, folder), questions(spark, folder))
    return _rounded(sheet, ["p_at", "ap_term", "dcg_term", "idcg_term"])


@query("eval_summary_with_mean", f"""WITH {_EVAL}
SELECT run_id, query_id, label, {_ROUNDED} FROM metrics
UNION ALL SELECT run_id, 'MEAN', 'mean of all queries',
  {", ".join(f"round(avg({m}), 6)" for m in E.METRICS)} FROM metrics GROUP BY 1""")
def eval_summary_with_mean(spark, folder):
    return _rounded(E.summary_with_mean(_metrics(spark, folder)), E.METRICS)


@query(
    "run_eval",
    f"""WITH {DATASETS}, {ARTIFACTS}, {_POSTINGS}, {_bm25(_BENCH_TERMS)}, top AS ({_BATCH_TOP})
    SELECT 'r1' AS run_id, query_id, rank AS result_rank, dataset_id, title, description, license_class,
           f IS NOT NULL AS has_schema
    FROM (SELECT top.*, d.title, substr(d.description, 1, 200) AS description, d.license_class, fresh.dataset_id AS f
          FROM top JOIN datasets d ON d.id = top.dataset_id LEFT JOIN fresh ON fresh.dataset_id = top.dataset_id)""",
)
def run_eval(spark, folder):
    """All benchmark queries through the BM25 engine."""
    datasets = V.datasets(spark, folder)
    asked = V.eval_queries(spark, folder)
    corpus = search_corpus(datasets)
    index = build_term_index(corpus, asked.select(F.col("id").alias("query_id"), "query"))
    tables = E.EngineTables(datasets, V.artifacts(spark, folder), corpus, index)
    _, hits = E.run_eval("bm25", tables, asked, k=10, as_of=V.CATALOG_AS_OF, run_id="r1")
    return hits.select(
        "run_id", "query_id", "result_rank", "dataset_id", "title",
        *[F.get_json_object("extra", f"$.{c}").alias(c) for c in ("description", "license_class")],
        F.get_json_object("extra", "$.has_schema").cast("boolean").alias("has_schema"),
    )


@query("run_eval_tokens", f"""WITH {DATASETS}, {_BENCH_TOKENS}, top AS ({_BATCH_TOP})
SELECT 'r2' AS run_id, query_id, rank AS result_rank, dataset_id, title, size_class
FROM top JOIN datasets ON id = dataset_id""")
def run_eval_tokens(spark, folder):
    """All benchmark queries through the token engine."""
    datasets = V.datasets(spark, folder)
    tables = E.EngineTables(datasets, V.artifacts(spark, folder), search_corpus(datasets))
    _, hits = E.run_eval("token_hits", tables, V.eval_queries(spark, folder), run_id="r2", as_of=V.CATALOG_AS_OF)
    return hits.select(
        "run_id", "query_id", "result_rank", "dataset_id", "title",
        F.get_json_object("extra", "$.size_class").alias("size_class"),
    )


@query(
    "eval_queries_put",
    """WITH base AS (SELECT 'B' || item_id AS id, text AS query, length(text) <= 150 AS active FROM benchmark),
    new AS (SELECT 'B' || item_id AS id, 'again' AS label, text AS query FROM benchmark WHERE length(text) > 250
            UNION ALL SELECT 'C' || conv_id, '', text FROM conversations WHERE turn = 0)
    SELECT id, 'benchmark' AS label, query, active FROM base WHERE id NOT IN (SELECT id FROM new)
    UNION ALL SELECT id, label, query, true FROM new""",
)
def eval_queries_put(spark, folder):
    """Long queries switched off, some of them put in again, and first turns added."""
    base = V.eval_queries(spark, folder)
    off = K.set_queries_active(base, base.filter("length(query) > 150"), False)
    again = base.filter("length(query) > 250").selectExpr("id", "'again' as label", "query")
    first = V.table(spark, folder, "conversations").filter("turn = 0").selectExpr(
        "concat('C', conv_id) as id", "cast(null as string) as label", "text as query"
    )
    return K.put_eval_queries(off, again.unionByName(first)).select("id", "label", "query", "active")


@query("judgments_put", f"""WITH {_EVAL},
new AS (SELECT DISTINCT query_id, dataset_id FROM ev WHERE event_type = 'purchase')
SELECT query_id, dataset_id, true AS relevant FROM new UNION ALL
SELECT query_id, dataset_id, relevant FROM judgments j WHERE NOT EXISTS (
  SELECT 1 FROM new WHERE new.query_id = j.query_id AND new.dataset_id = j.dataset_id)""")
def judgments_put(spark, folder):
    """What was purchased becomes relevant."""
    bought = V.table(spark, folder, "events").filter("event_type = 'purchase'").selectExpr(
        f"{_ASKED} as query_id", "get_json_object(props, '$.k') as dataset_id"
    ).distinct()
    new = conform(bought.withColumn("relevant", F.lit(True)), "eval_judgments")
    return K.put_judgments(judgments(spark, folder), new).select("query_id", "dataset_id", "relevant")


@query(
    "signals_windowed",
    f"""WITH {SIGNALS}, placed AS (
      SELECT dataset_id, date_trunc('day', created_at) - to_days(CAST(unnest(range(7)) AS INTEGER)) AS start FROM signals)
    SELECT epoch_us(start) AS window_start, epoch_us(start + INTERVAL 7 DAY) AS window_end, dataset_id, count(*) AS sig_score
    FROM placed GROUP BY ALL""",
)
def signals_windowed(spark, folder):
    counts = windowed_signal_counts(V.signals(spark, folder))
    return counts.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})
