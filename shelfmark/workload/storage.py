"""Queries that go through files: scans of raw inputs, logs, stores and streams, all in the shared folder."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import constants as C
from shelfmark import views as V
from shelfmark.functions import vectors as VF
from shelfmark.operators import keyed as K
from shelfmark.operators import rolled as R
from shelfmark.operators.numbering import numbered
from shelfmark.plans import dense as D
from shelfmark.plans import evaluation as E
from shelfmark.plans import ingest as I
from shelfmark.session import shared_path
from shelfmark.sources import buckets as B
from shelfmark.sources import scans
from shelfmark.sources import tables as S
from shelfmark.streaming import requests as RQ
from shelfmark.streaming import streams
from shelfmark.workload import ingest as W
from shelfmark.workload import dense as WD
from shelfmark.workload.dense import DIMENSIONS, DigestEmbedder
from shelfmark.workload.evaluation import _EVAL, results, runs
from shelfmark.workload.registry import DATASETS, ORACLE, SIGNALS, VECTORS, query


@query("scan_jsonl", ORACLE["canonical_projection"])
def scan_jsonl(spark, folder):
    """The lines of canonical_projection, written as text files and scanned."""
    path = shared_path(spark, "jsonl")
    W.jsonl_lines(spark, folder).select("value").write.text(path)
    return W._flat_records(I.ingest_jsonl(scans.read_lines(spark, path), as_of=V.CATALOG_AS_OF).records)


@query("scan_parquet", ORACLE["parquet_records"])
def scan_parquet(spark, folder):
    """The enriched rows of parquet_records, written as Parquet files and scanned."""
    path = shared_path(spark, "enriched")
    rows, cards = W.parquet_rows(spark, folder)
    rows.drop("seq").write.parquet(path)
    return W._flat_records(I.ingest_parquet(scans.read_parquet_rows(spark, path), cards, as_of=V.CATALOG_AS_OF).records)


# A catalog document takes entries up to about so many characters; one longer entry is a document of its own.
DOCUMENT_CHARS = 8 << 20


def catalog_documents(entries, limit=None):
    """(source, part, value): the entries (source, position, entry as text) of each source as documents of bounded size.

    Parts follow the positions within a source, and sort as text.
    """
    limit = limit or DOCUMENT_CHARS

    def cut(batches):
        task, number = TaskContext.get().partitionId(), 0
        source, held, size = None, [], 0

        def document():
            columns = [pa.array([source], pa.string()), pa.array([f"{task:06d}-{number:06d}"]), pa.array(['{"datasets":[' + ",".join(held) + "]}"])]
            return pa.RecordBatch.from_arrays(columns, ["source", "part", "value"])

        for batch in batches:
            for now, entry in zip(batch.column("source").to_pylist(), batch.column("entry").to_pylist()):
                if held and (now != source or size + len(entry) > limit):
                    yield document()
                    number, held, size = number + 1, [], 0
                source = now
                held.append(entry)
                size += len(entry)
        if held:
            yield document()

    ordered = entries.select("source", "position", "entry").repartitionByRange("source", "position").sortWithinPartitions("source", "position")
    return ordered.mapInArrow(cut, "source string, part string, value string")


@query("scan_catalog", ORACLE["catalog_records"])
def scan_catalog(spark, folder):
    """The entries of catalog_records as catalog documents, of bounded size and one source each, written and scanned."""
    path = shared_path(spark, "catalog")
    entries = W.entries(spark, folder).join(
        V.table(spark, folder, "documents").select(F.col("doc_id").alias("position"), "source"), "position"
    )
    documents = catalog_documents(entries.select("source", "position", F.to_json("entry").alias("entry")))
    documents.write.partitionBy("source", "part").text(path)
    records = W._flat_records(I.ingest_catalog(scans.read_catalog_entries(spark, path), V.CATALOG_AS_OF).records)
    return records.select(
        "id", "ns_local_id", "title", "readme_text", "access_class", "fingerprint", "readme_tokens", "downloads"
    )


@query("signal_log", f"""WITH {SIGNALS} SELECT CAST(created_at AS DATE) AS day, event, count(*) AS signals,
count(DISTINCT id) AS ids FROM signals GROUP BY ALL""")
def signal_log(spark, folder):
    """Signals appended in two batches to a log that is partitioned by day."""
    path = shared_path(spark, "signals")
    signals = K.as_signal_log(V.signals(spark, folder))
    for batch in ("event in ('view', 'click')", "event not in ('view', 'click')"):
        S.append_log(signals.filter(batch), path)
    return spark.read.parquet(path).groupBy("day", "event").agg(
        F.count("*").alias("signals"), F.count_distinct("id").alias("ids")
    )


@query(
    "sample_store_reimport",
    """SELECT 'conv-' || conv_id || '::' || role || '::train::' || turn AS row_id, 'conv-' || conv_id AS dataset_id,
              CASE WHEN role = 'user' THEN '2024-02-01' ELSE '2024-01-31' END AS sampled_at,
              CASE WHEN role = 'user' THEN 'again ' || text ELSE text END AS row_text
       FROM conversations""",
)
def sample_store_reimport(spark, folder):
    """Sample rows stored together with a later import of the same ids for one role: the later row stays."""
    rows = V.sample_rows(spark, folder)
    later = rows.filter("config = 'user'").withColumn("sampled_at", F.lit("2024-02-01"))
    later = later.withColumn("row_text", F.concat(F.lit("again "), "row_text"))
    path = shared_path(spark, "sample-rows")
    S.write_sample_rows(rows.unionByName(later), path)
    return spark.read.parquet(path).select("row_id", "dataset_id", "sampled_at", "row_text")


@query("sample_store_dataset", """SELECT role AS config, CAST(turn AS INTEGER) AS row_index, text AS row_text
FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)""")
def sample_store_dataset(spark, folder):
    """The rows of one dataset out of the store."""
    path = shared_path(spark, "sample-rows")
    rows = V.sample_rows(spark, folder)
    buckets = S.write_sample_rows(rows, path)
    last = V.table(spark, folder, "conversations").agg(F.max("conv_id")).first()[0]
    stored = S.read_dataset_rows(spark.read.parquet(path), f"conv-{last}", buckets)
    return stored.select("config", "row_index", "row_text")


@query("vector_blobs", f"""WITH {VECTORS}
SELECT dataset_id, CAST(len(vector) AS INTEGER) AS dimensions, round(list_sum(vector), 5) AS total FROM vectors""")
def vector_blobs(spark, folder):
    """Vectors held as float32 bytes, read as arrays."""

    @F.arrow_udf(T.BinaryType())
    def as_bytes(vectors: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v, dtype="<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    blobs = V.vectors(spark, folder).withColumn("vector", as_bytes("vector"))
    ones = F.array_repeat(F.lit(1.0), DIMENSIONS)
    moved = D.convert_legacy_vectors(blobs)
    return moved.select("dataset_id", F.size("vector").alias("dimensions"), F.round(VF.dot("vector", ones), 5).alias("total"))


@query("eval_queries_listed", "SELECT 'B' || item_id AS id, text AS query FROM benchmark WHERE length(text) <= 150")
def eval_queries_listed(spark, folder):
    """The active queries, after long ones were switched off."""
    base = V.eval_queries(spark, folder)
    off = K.set_queries_active(base, base.filter("length(query) > 150"), False)
    return E.list_queries(off).select("id", "query")


_SEEDS = ", ".join(
    "(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in row[:3]) + ")" for row in C.SEED_EVAL_QUERIES
)


@query("seed_queries_put", f"""SELECT 'B' || item_id AS id, 'benchmark' AS label, text AS query FROM benchmark
UNION ALL SELECT * FROM (VALUES {_SEEDS}) AS seeds(id, label, query)""")
def seed_queries_put(spark, folder):
    """The query set to start from, put into the benchmark's queries."""
    put = K.put_eval_queries(V.eval_queries(spark, folder), E.seed_queries(spark, V.CATALOG_AS_OF))
    return put.select("id", "label", "query")


@query("eval_runs_listed", """SELECT event_type AS id, 'run ' || event_type AS label, epoch_us(min(ts)) AS created_at,
CAST(row_number() OVER (ORDER BY min(ts) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY event_type""")
def eval_runs_listed(spark, folder):
    """All runs, the latest first, with their places: numbers given in the order of the listing."""
    listed = numbered(E.list_runs(runs(spark, folder)).select("id", "label", "created_at"), "place")
    return listed.select("id", "label", F.unix_micros("created_at").alias("created_at"), (F.col("place") + 1).cast("int").alias("place"))


@query("run_results_put", f"""WITH {_EVAL}
SELECT run_id, query_id, CAST(i AS INTEGER) AS result_rank, dataset_id,
       CASE WHEN i = 1 THEN 'first' ELSE run_id END AS title FROM results""")
def run_results_put(spark, folder):
    """Results of all runs, with the first of every list put in again."""
    base = results(spark, folder)
    again = base.filter("result_rank = 1").withColumn("title", F.lit("first"))
    return K.put_run_results(base, again).select("run_id", "query_id", "result_rank", "dataset_id", "title")


_BYTES = ", ".join(f"CAST('0x' || substr(sha256(text), {2 * i + 1}, 2) AS INTEGER) / 255.0" for i in range(8))
# The eight float32 numbers that DigestEmbedder makes of a text.
_DIGEST = "list_transform(raw, lambda x: CAST(CAST(x / sqrt(list_dot_product(raw, raw)) AS FLOAT) AS DOUBLE))"
_CATALOG_TEXT = "concat_ws(' ', title, description, readme_text, tags, coalesce(modalities, ''), languages)"


@query(
    "run_eval_dense",
    f"""WITH {DATASETS},
    texts AS (SELECT id, {_CATALOG_TEXT} AS text FROM datasets),
    stored AS (SELECT id, {_DIGEST} AS v FROM (SELECT id, [{_BYTES}]::DOUBLE[] AS raw FROM texts)),
    asked AS (SELECT 'B' || item_id AS query_id, {_DIGEST} AS q FROM (SELECT item_id, [{_BYTES}]::DOUBLE[] AS raw FROM benchmark)),
    pairs AS (SELECT query_id, id, round(list_dot_product(v, q), 12) AS score FROM stored, asked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i FROM pairs)
    SELECT 'r3' AS run_id, query_id, CAST(i AS INTEGER) AS result_rank, id AS dataset_id, round(score, 5) AS score
    FROM ranked WHERE i <= 10""",
)
def run_eval_dense(spark, folder):
    """All benchmark queries through the dense engine; a hit tells its score."""
    datasets, embedder = V.datasets(spark, folder), DigestEmbedder()
    vectors = D.embed_catalog(datasets, V.vectors(spark, folder), embedder, force=True, as_of=V.CATALOG_AS_OF)
    tables = E.EngineTables(datasets, V.artifacts(spark, folder), vectors=vectors, embedder=embedder)
    _, hits = E.run_eval("dense", tables, V.eval_queries(spark, folder), k=10, as_of=V.CATALOG_AS_OF, run_id="r3")
    score = F.round(F.get_json_object("extra", "$.score").cast("double"), 5)
    return hits.select("run_id", "query_id", "result_rank", "dataset_id", score.alias("score"))


@query("listing_stream", f"WITH {W._LISTING} {W._LISTED}")
def listing_stream(spark, folder):
    """A listing that lands as files in two steps, each taken in once by a stream."""
    base = shared_path(spark, "listing")
    listing = V.listing(spark, folder)
    schema = listing.schema

    def take_in(batch, number):
        rows = batch.select(F.from_json("value", schema).alias("row")).select("row.*")
        records, _ = I.ingest_listing(rows, as_of=V.CATALOG_AS_OF)
        records.write.mode("overwrite").parquet(f"{base}/records/batch={number}")

    for step, part in enumerate(("private", "not private")):
        listing.filter(part).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{base}/landing/step={step}")
        stream = streams.stream_lines(spark, f"{base}/landing/*")
        streams.run_available(stream, take_in, "listing", f"{base}/checkpoint").awaitTermination()
    return W._listed(spark.read.parquet(f"{base}/records"))


@query("signals_stream", f"""WITH {SIGNALS}
SELECT id, dataset_id, event, epoch_us(created_at) AS created_at FROM signals""")
def signals_stream(spark, folder):
    """Signals of a log that holds some of them twice, each once."""
    base = shared_path(spark, "signals")
    signals = V.signals(spark, folder)
    S.write_snapshot(signals.unionByName(signals.filter("event = 'click'")), f"{base}/log")
    unique = streams.without_repeats(streams.stream_table(spark, "signals", f"{base}/log"), "3650 days")
    sink = unique.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    sink.trigger(availableNow=True).start(f"{base}/unique").awaitTermination()
    return spark.read.parquet(f"{base}/unique").select("id", "dataset_id", "event", F.unix_micros("created_at").alias("created_at"))


@query("upsert_touched", ORACLE["upsert_datasets"])
def upsert_touched(spark, folder):
    """The updates of upsert_datasets, put into a table in buckets; untouched buckets stay as they are."""
    path, stored = shared_path(spark, "datasets-in-buckets"), V.datasets(spark, folder)
    B.write_buckets(stored, path, ["id"], 32)
    records = K.keep_last(W.updates(spark, folder), ["id"], ["seq"]).select(*stored.columns)
    B.upsert_buckets(path, records, ["id"], 32)
    return B.read_buckets(spark, path, stored).select("id", "title", "fingerprint")


@query("dense_topk_bucketed", ORACLE["dense_topk_batch_filtered"])
def dense_topk_bucketed(spark, folder):
    """The filtered batch search over tables bucketed by dataset: vectors are filtered where they lie."""
    vectors, datasets, _ = WD._tables(spark, folder)
    vectors = B.bucketed_table(vectors, shared_path(spark, "vectors"), "dataset_id", 16)
    datasets = B.bucketed_table(datasets.drop("readme_text"), shared_path(spark, "datasets"), "id", 16)
    return WD._rounded(D.search_dense_batch(vectors, datasets, WD.centres(spark, folder), 10, WD.FILTERS))


@query(
    "signal_scores_rolled",
    f"""WITH {SIGNALS}, daily AS (
      SELECT dataset_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM signals WHERE dataset_id IS NOT NULL GROUP BY ALL),
    days AS (SELECT dataset_id, day FROM daily UNION SELECT dataset_id, day + 7 FROM daily)
    SELECT p.day, p.dataset_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
    FROM days p LEFT JOIN daily d ON d.dataset_id = p.dataset_id AND d.day BETWEEN p.day - 6 AND p.day GROUP BY ALL""",
)
def signal_scores_rolled(spark, folder):
    """Counts of the last seven days for all days, from two batches of changes: a third of the signals comes late."""
    path, signals = shared_path(spark, "signal-changes"), V.signals(spark, folder)
    late = F.col("user_id").cast("bigint") % 3 == 0
    R.commit_changes(path, "on-time", signals.filter(~F.coalesce(late, F.lit(False))))
    R.commit_changes(path, "late", signals.filter(late))
    return R.rolled(R.read_changes(spark, path))


_LEASE_HOURS, _ATTEMPTS = 12, 2
_ACTIONS = {"view": RQ.REQUEST, "click": RQ.START, "signup": RQ.DONE, "error": RQ.FAILED, "purchase": RQ.STALE}
_ACTION_SQL = " ".join(f"WHEN '{event}' THEN '{action}'" for event, action in _ACTIONS.items())


@query(
    "request_stream",
    f"""WITH log AS (
      SELECT CAST(user_id AS VARCHAR) AS dataset_id, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS at_us,
             CASE event_type {_ACTION_SQL} END AS action
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    known AS (
      SELECT *, coalesce((last_value(CASE WHEN action IN ('done', 'stale') THEN action END IGNORE NULLS) OVER past) = 'done', false) AS fresh,
             coalesce(count(*) FILTER (WHERE action IN ('done', 'failed')) OVER past, 0) AS closed
      FROM log WHERE action IS NOT NULL
      WINDOW past AS (PARTITION BY dataset_id ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    jobs AS (
      SELECT *, first_value(CASE WHEN action = 'request' AND NOT fresh THEN id END IGNORE NULLS) OVER opened AS job
      FROM known WINDOW opened AS (PARTITION BY dataset_id, closed ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    starts AS (
      SELECT *, lead(at_us) OVER (PARTITION BY dataset_id ORDER BY at_us, id) AS then_at,
             count(*) FILTER (WHERE action = 'start') OVER (PARTITION BY dataset_id, closed ORDER BY at_us, id) AS attempt
      FROM jobs WHERE action IN ('done', 'failed') OR (action = 'start' AND job IS NOT NULL))
    SELECT dataset_id, 'schema' AS kind, id, at_us,
           CASE WHEN fresh THEN 'cached' WHEN job = id THEN 'queued' ELSE 'joined' END AS outcome,
           CASE WHEN NOT fresh THEN job END AS job_id
    FROM jobs WHERE action = 'request'
    UNION ALL
    SELECT dataset_id, 'schema', id, at_us + {_LEASE_HOURS} * 3600000000, CASE WHEN attempt < {_ATTEMPTS} THEN 'requeued' ELSE 'given up' END, job
    FROM starts WHERE action = 'start' AND (then_at IS NULL OR then_at > at_us + {_LEASE_HOURS} * 3600000000)""",
)
def request_stream(spark, folder):
    """Requests decided by a stream with state and leases, from a log that lands in two steps; a seventh of the first comes with the second."""
    base = shared_path(spark, "requests")
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])
    events = V.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("dataset_id"), F.lit("schema").alias("kind"),
        F.element_at(action, F.col("event_type")).alias("action"), F.col("ts").cast("timestamp").alias("at"),
    )
    step = ((F.dayofmonth("at") > 15) | (F.pmod(F.xxhash64("id"), F.lit(7)) == 0)).cast("int")
    # A last row moves the watermark past all others and their leases.
    end = spark.sql("select 'end' as id, '' as dataset_id, 'schema' as kind, 'stale' as action, timestamp'2100-01-01' as at")
    log = f"{base}/log"
    schema = events.limit(0).schema
    for number in range(3):
        part = end if number == 2 else events.filter(F.coalesce(step, F.lit(0)) == number)
        part.write.parquet(f"{log}/step={number}")
        arrived = spark.readStream.schema(schema).parquet(f"{log}/*")
        outcomes = RQ.decide_stream(arrived, "16 days", _LEASE_HOURS * 3600, _ATTEMPTS)
        RQ.run_decisions(outcomes, f"{base}/outcomes", f"{base}/checkpoint")
    return spark.read.schema(RQ.OUTCOMES).parquet(f"{base}/outcomes")
