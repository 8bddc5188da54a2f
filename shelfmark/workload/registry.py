"""Registry of queries and the SQL each is checked against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark import constants as C

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


# Pieces of SQL that give the views of shelfmark.views -------------------------

NOT_SPACE = "[^" + C.WHITESPACE[1:-2] + "]+"
TERM = r"[\p{L}\p{N}_]+"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
JOBS_AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"

DATASETS = f"""
datasets AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'doc-' || doc_id AS ns_local_id, source AS title,
         lang || ' text from ' || source AS description, text AS readme_text,
         '["lang:' || lang || '", "src:' || source || '"]' AS tags,
         CASE WHEN lang = 'de' THEN '["text", "tabular"]' WHEN lang <> 'es' THEN '["text"]' END AS modalities,
         CASE lang WHEN 'en' THEN 'mit' WHEN 'fr' THEN 'apache-2.0' WHEN 'de' THEN 'cc-by-nc-4.0' END AS license_class,
         CASE WHEN source IN ('src0', 'src1') THEN 'private' ELSE 'public' END AS access_class,
         CASE WHEN n_chars < 1000 THEN 'n<1K' WHEN n_chars < 10000 THEN '1K<n<10K' ELSE '10K<n<100K' END AS size_class,
         '["' || lang || '"]' AS languages,
         {AS_OF} - to_hours(n_chars % 720) AS last_seen_lm,
         {AS_OF} - to_hours(n_chars % 48) AS indexed_at,
         len(regexp_extract_all(text, '{NOT_SPACE}')) AS readme_tokens,
         least(len(regexp_extract_all(text, '{NOT_SPACE}')) / 50.0, 1.0) AS readme_score,
         CASE WHEN lang <> 'es' THEN n_chars * 3 END AS downloads, length(source) AS likes,
         'doc:' || doc_id || ':' || n_chars AS fingerprint
  FROM documents),
corpus AS (
  SELECT id, lower(concat_ws(' ', title, description, readme_text, tags, coalesce(modalities, ''), languages)) AS content
  FROM datasets)"""

ARTIFACTS = """
artifacts AS (
  SELECT CAST(doc_id AS VARCHAR) AS dataset_id, CASE WHEN quality = 1 THEN 'schema' ELSE 'snips' END AS kind,
         toxic = 1 AS stale
  FROM labels),
fresh AS (SELECT DISTINCT dataset_id FROM artifacts WHERE kind = 'schema' AND NOT stale)"""

JOBS = """
jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS dataset_id,
         CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'error'
              WHEN o_orderpriority = '1-URGENT' THEN 'running' ELSE 'queued' END AS state,
         coalesce(attempts, 0) AS attempts,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error_class,
         o_orderdate AS enqueued_at, o_orderdate AS started_at, finished_at
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS finished_at, count(*) AS attempts
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

SIGNALS = """
signals AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS event,
         json_extract_string(props, '$.k') AS dataset_id, ts AS created_at
  FROM events)"""

VECTORS = """
vectors AS (SELECT CAST(vec_id AS VARCHAR) AS dataset_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""
