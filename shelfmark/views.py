"""The driver's test tables seen as catalog tables."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.schemas import conform

CATALOG_AS_OF = "2024-01-31 00:00:00"
JOBS_AS_OF = "1998-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as catalog rows."""
    documents = table(spark, folder, "documents").withColumn("tokens", X.token_count("text"))

    def hours_back(hours: str) -> str:
        return f"timestamp_micros(unix_micros(timestamp'{CATALOG_AS_OF}') - {hours} * 3600000000)"

    return conform(
        documents.selectExpr(
            "cast(doc_id as string) as id",
            "'documents' as source",
            "concat('doc-', doc_id) as ns_local_id",
            "source as title",
            "concat(lang, ' text from ', source) as description",
            "text as readme_text",
            "array(concat('lang:', lang), concat('src:', source)) as tags",
            "case when lang = 'de' then array('text', 'tabular') when lang <> 'es' then array('text') end as modalities",
            "case lang when 'en' then 'mit' when 'fr' then 'apache-2.0' when 'de' then 'cc-by-nc-4.0' end as license_class",
            "case when source in ('src0', 'src1') then 'private' else 'public' end as access_class",
            "case when n_chars < 1000 then 'n<1K' when n_chars < 10000 then '1K<n<10K' else '10K<n<100K' end as size_class",
            "array(lang) as languages",
            f"{hours_back('(n_chars % 720)')} as last_seen_lm",
            "sha2(text, 256) as readme_sha256",
            "concat('doc:', doc_id, ':', n_chars) as fingerprint",
            f"{hours_back('(n_chars % 48)')} as indexed_at",
            "tokens as readme_tokens",
            "least(tokens / 50D, 1D) as readme_score",
            "map('downloads', case when lang <> 'es' then cast(n_chars * 3 as string) end, "
            "'likes', cast(length(source) as string)) as quality_signals",
        ),
        "datasets",
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as stored artifacts: good documents have a schema, toxic ones a stale one."""
    return conform(
        table(spark, folder, "labels").select(
            F.col("doc_id").cast("string").alias("dataset_id"),
            F.when(F.col("quality") == 1, "schema").otherwise("snips").alias("kind"),
            F.lit("{}").alias("payload"),
            F.lit(CATALOG_AS_OF).cast("timestamp").alias("created_at"),
            (F.col("toxic") == 1).alias("stale"),
        ),
        "artifacts",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as jobs; a job ends with the first shipment, and every line is an attempt."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("finished_at"), F.count("*").cast("int").alias("attempts")
    )
    orders = table(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return conform(
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_custkey").cast("string").alias("dataset_id"),
            F.lit("schema").alias("kind"),
            F.when(status == "F", "done").when(status == "P", "error")
            .when(priority == "1-URGENT", "running").otherwise("queued").alias("state"),
            F.coalesce("attempts", F.lit(0)).alias("attempts"),
            F.when(status == "P", priority).alias("error_class"),
            F.col("o_orderdate").alias("enqueued_at"),
            F.col("o_orderdate").alias("started_at"),
            "finished_at",
        ),
        "jobs",
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as usage signals."""
    return conform(
        table(spark, folder, "events").select(
            F.col("event_id").cast("string").alias("id"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("event_type").alias("event"),
            F.get_json_object("props", "$.k").alias("dataset_id"),
            F.col("ts").alias("created_at"),
        ),
        "signals",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return conform(
        table(spark, folder, "embeddings").select(
            F.col("vec_id").cast("string").alias("dataset_id"),
            F.lit("given-64").alias("model"),
            F.col("embedding").alias("vector"),
            F.lit(CATALOG_AS_OF).cast("timestamp").alias("updated_at"),
        ),
        "vectors",
    )


def eval_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as queries, with three or more documents counted as relevant."""
    return conform(
        table(spark, folder, "benchmark").select(
            F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("id"),
            F.lit("benchmark").alias("label"),
            F.col("text").alias("query"),
            (F.length(F.col("item_id").cast("string")) + 2).alias("total_relevant"),
            F.lit(True).alias("active"),
            F.lit(CATALOG_AS_OF).cast("timestamp").alias("created_at"),
        ),
        "eval_queries",
    )


def sample_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as sample lines: one line per conversation and role, with its turns as rows."""
    row = F.struct("role", "text", "turn", (F.col("role") == "user").alias("asked"))
    turns = table(spark, folder, "conversations").groupBy("conv_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))), lambda t: t.row).alias("rows")
    )
    line = F.struct(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"),
        F.col("role").alias("config"),
        F.lit("train").alias("split"),
        F.lit("2024-01-31").alias("sampled_at"),
        "rows",
    )
    return turns.select(F.struct("conv_id", "role").alias("seq"), F.to_json(line).alias("value"))


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as stored sample rows."""
    return conform(
        table(spark, folder, "conversations").select(
            F.concat_ws("::", F.concat(F.lit("conv-"), "conv_id"), "role", F.lit("train"), "turn").alias("row_id"),
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("dataset_id"),
            F.col("role").alias("config"),
            F.lit("train").alias("split"),
            F.lit("2024-01-31").alias("sampled_at"),
            F.col("turn").cast("int").alias("row_index"),
            F.col("text").alias("row_text"),
            F.to_json(F.struct("role", "text", "turn")).alias("row"),
        ),
        "sample_rows",
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rows of a hub listing."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("/order-"),
                 F.col("o_orderkey").cast("string")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"),
        F.array("o_orderpriority").alias("tags"),
        F.when(F.col("o_orderstatus") != "O", "mit").alias("license"),
        (F.col("o_orderstatus") == "P").alias("private"),
        F.col("o_totalprice").cast("bigint").alias("downloads"),
        F.col("o_custkey").alias("likes"),
    )
