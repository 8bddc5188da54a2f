"""Operational queries: metrics, prefetching, policy, job log."""

from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark import views as V
from shelfmark.functions.times import micros_between
from shelfmark.operators import metrics as M
from shelfmark.operators import policy as P
from shelfmark.operators import quantiles as Q
from shelfmark.plans import health as H
from shelfmark.session import materialised
from shelfmark.workload.registry import ARTIFACTS, AS_OF, DATASETS, JOBS, JOBS_AS_OF, ORACLE, SIGNALS, query

_P95 = """
durations AS (
  SELECT (epoch_us(finished_at) - epoch_us(started_at)) / 1000 AS ms,
         row_number() OVER (ORDER BY epoch_us(finished_at) - epoch_us(started_at)) AS place, count(*) OVER () AS n
  FROM jobs WHERE state = 'done' AND finished_at IS NOT NULL AND started_at IS NOT NULL),
p95 AS (
  SELECT coalesce((SELECT ms FROM durations WHERE place = greatest(CAST(floor(n * 0.95) AS BIGINT), 1)), 0.0) AS resolve_p95_ms),
depth AS (SELECT count(*) AS queue_depth FROM jobs WHERE state = 'queued')"""


def _reason(p95_max: str, depth_max: str) -> str:
    return f"CASE WHEN resolve_p95_ms > {p95_max} THEN 'resolve_slow' WHEN queue_depth > {depth_max} THEN 'queue_depth' END"


@query(
    "state_view",
    f"""WITH {DATASETS}, {ARTIFACTS}, {JOBS}
    SELECT d.id, CAST(max(CASE WHEN a.kind = 'schema' AND NOT a.stale THEN 1 ELSE 0 END) AS INTEGER) AS has_schema,
           CAST(max(CASE WHEN a.kind = 'snips' AND NOT a.stale THEN 1 ELSE 0 END) AS INTEGER) AS has_snips,
           CAST(max(CASE WHEN j.state = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS recent_errors,
           epoch_us({JOBS_AS_OF}) AS last_refreshed_at
    FROM datasets d LEFT JOIN artifacts a ON a.dataset_id = d.id
    LEFT JOIN jobs j ON j.dataset_id = d.id AND j.enqueued_at > {JOBS_AS_OF} - INTERVAL 7 DAY
    GROUP BY d.id""",
)
def state_view(spark, folder):
    tables = V.datasets(spark, folder), V.artifacts(spark, folder), V.jobs(spark, folder)
    state = M.dataset_state(*tables, as_of=V.JOBS_AS_OF)
    return state.withColumn("last_refreshed_at", F.unix_micros("last_refreshed_at"))


@query("job_states", f"WITH {JOBS} SELECT state, count(*) AS jobs FROM jobs GROUP BY state")
def job_states(spark, folder):
    return M.job_states(V.jobs(spark, folder))


@query("error_taxonomy", f"""WITH {JOBS}
SELECT error_class, count(*) AS jobs FROM jobs WHERE error_class IS NOT NULL GROUP BY 1""")
def error_taxonomy(spark, folder):
    return M.error_taxonomy(V.jobs(spark, folder))


@query("resolve_p95", f"WITH {JOBS}, {_P95} SELECT resolve_p95_ms FROM p95")
def resolve_p95(spark, folder):
    return M.resolve_p95(V.jobs(spark, folder))


@query("pause_decision", f"""WITH {JOBS}, {_P95}
SELECT resolve_p95_ms, queue_depth, {_reason("3000", "500")} IS NOT NULL AS prefetch_paused,
       {_reason("3000", "500")} AS prefetch_reason FROM p95, depth""")
def pause_decision(spark, folder):
    return H.should_pause(V.jobs(spark, folder))


@query("pause_decision_depth", f"""WITH {JOBS}, {_P95}
SELECT resolve_p95_ms, queue_depth, {_reason("1e15", "1")} IS NOT NULL AS prefetch_paused,
       {_reason("1e15", "1")} AS prefetch_reason FROM p95, depth""")
def pause_decision_depth(spark, folder):
    settings = P.PolicySettings(p95_max_ms=1e15, queue_depth_max=1)
    return H.should_pause(V.jobs(spark, folder), settings)


@query("pause_decision_none", f"""WITH {JOBS}, {_P95}
SELECT resolve_p95_ms, queue_depth, {_reason("1e15", "1e15")} IS NOT NULL AS prefetch_paused,
       {_reason("1e15", "1e15")} AS prefetch_reason FROM p95, depth""")
def pause_decision_none(spark, folder):
    settings = P.PolicySettings(p95_max_ms=1e15, queue_depth_max=10**15)
    return H.should_pause(V.jobs(spark, folder), settings)


@query(
    "admin_metrics",
    f"""WITH {DATASETS}, {ARTIFACTS}, {JOBS}, {_P95},
    facts AS (SELECT d.*, f.dataset_id IS NOT NULL AS covered FROM datasets d LEFT JOIN fresh f ON f.dataset_id = d.id),
    counts AS (
      SELECT count(*) AS total, count(*) FILTER (indexed_at >= {AS_OF} - INTERVAL 1 DAY) AS fresh,
             count(*) FILTER (readme_tokens IS NULL OR readme_tokens < 50 OR readme_score < 0.35) AS thin,
             count(*) FILTER (access_class = 'public') AS public,
             count(*) FILTER (access_class = 'public' AND covered) AS with_schema
      FROM facts)
    SELECT round(fresh / total * 100, 6) AS freshness_pct, round(thin / total * 100, 6) AS thin_readme_pct,
           public - with_schema AS public_no_schema_count, round(with_schema / public * 100, 6) AS public_with_schema_pct,
           resolve_p95_ms, queue_depth,
           (SELECT '{{' || string_agg('"' || error_class || '":' || n, ',' ORDER BY error_class) || '}}'
            FROM (SELECT error_class, count(*) AS n FROM jobs WHERE error_class IS NOT NULL GROUP BY 1)) AS error_taxonomy,
           (SELECT '{{' || string_agg('"' || state || '":' || n, ',' ORDER BY state) || '}}'
            FROM (SELECT state, count(*) AS n FROM jobs GROUP BY 1)) AS jobs_by_state,
           {_reason("3000", "500")} AS prefetch_reason, {_reason("3000", "500")} IS NOT NULL AS prefetch_paused
    FROM counts, p95, depth""",
)
def admin_metrics(spark, folder):
    row = H.admin_metrics(
        V.datasets(spark, folder), V.artifacts(spark, folder), V.jobs(spark, folder), as_of=V.CATALOG_AS_OF
    )
    shares = ["freshness_pct", "thin_readme_pct", "public_with_schema_pct"]
    return row.withColumns({c: F.round(c, 6) for c in shares})


@query("signal_counts_7d", f"""WITH {SIGNALS}
SELECT dataset_id, count(*) AS sig_score FROM signals WHERE created_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1""")
def signal_counts_7d(spark, folder):
    return M.signal_counts(V.signals(spark, folder), as_of=V.CATALOG_AS_OF)


_CANDIDATES = f"""
sig AS (SELECT dataset_id, count(*) AS sig_score FROM signals WHERE created_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1),
candidates AS (
  SELECT d.id AS dataset_id, coalesce(sig_score, 0) AS sig_score, CAST(downloads AS BIGINT) AS downloads, last_seen_lm
  FROM datasets d LEFT JOIN fresh f ON f.dataset_id = d.id LEFT JOIN sig ON sig.dataset_id = d.id
  WHERE access_class = 'public' AND (readme_tokens IS NULL OR readme_tokens < 50 OR readme_score < 0.35)
        AND f.dataset_id IS NULL
  ORDER BY coalesce(sig_score, 0) DESC, downloads DESC NULLS LAST, last_seen_lm DESC NULLS LAST, d.id LIMIT 100)"""


def _candidates(spark, folder):
    return H.prefetch_candidates(
        V.datasets(spark, folder), V.artifacts(spark, folder), V.signals(spark, folder), 100, V.CATALOG_AS_OF
    )


@query("prefetch_candidates", f"""WITH {DATASETS}, {ARTIFACTS}, {SIGNALS}, {_CANDIDATES}
SELECT dataset_id, sig_score, downloads, epoch_us(last_seen_lm) AS last_seen_lm FROM candidates""")
def prefetch_candidates(spark, folder):
    return _candidates(spark, folder).withColumn("last_seen_lm", F.unix_micros("last_seen_lm"))


@query("prefetch_jobs", f"""WITH {DATASETS}, {ARTIFACTS}, {SIGNALS}, {_CANDIDATES}
SELECT 'prefetch-' || dataset_id AS id, dataset_id, 'schema' AS kind, 'queued' AS state, 0 AS attempts,
       1500 AS budget_ms, 200 AS row_cap, epoch_us({AS_OF}) AS enqueued_at FROM candidates""")
def prefetch_jobs(spark, folder):
    jobs = H.prefetch_jobs(_candidates(spark, folder), V.CATALOG_AS_OF)
    return jobs.select(
        "id", "dataset_id", "kind", "state", "attempts", "budget_ms", "row_cap",
        F.unix_micros("enqueued_at").alias("enqueued_at"),
    )


def requests(spark, folder):
    """Events as resolve requests, with a budget out of the event's value."""
    return V.table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.get_json_object("props", "$.k").alias("dataset_id"),
        F.when(F.col("event_type").isin("view", "click"), "schema").otherwise("snips").alias("kind"),
        (F.col("value") * 25).cast("int").alias("budget_ms"),
        F.col("user_id").cast("int").alias("row_cap"),
    )


_REQUESTS = """
requests AS (
  SELECT event_id AS request_id, json_extract_string(props, '$.k') AS dataset_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'schema' ELSE 'snips' END AS kind,
         CAST(trunc(value * 25) AS INTEGER) AS budget_ms, CAST(user_id AS INTEGER) AS row_cap
  FROM events)"""
_ALLOWED = ", ".join(f"'{x}'" for x in C.LICENSE_ALLOWLIST)
_JUDGED = f"""
judged AS (
  SELECT r.*, CASE WHEN d.id IS NULL THEN 'not_applicable' WHEN access_class <> 'public' THEN 'gated_private'
                   WHEN license_class NOT IN ({_ALLOWED}) THEN 'license_denied'
                   WHEN size_class = '10K<n<100K' THEN 'size_exceeded'
                   WHEN budget_ms > 1500 OR row_cap > 200 THEN 'time_budget_exceeded' END AS reason_code
  FROM requests r LEFT JOIN datasets d ON d.id = r.dataset_id)"""
SETTINGS = P.PolicySettings(max_size_class="1K<n<10K")


@query("policy_check", f"""WITH {DATASETS}, {_REQUESTS}, {_JUDGED}
SELECT *, reason_code IS NULL AS allow FROM judged""")
def policy_check(spark, folder):
    return P.evaluate_policy(requests(spark, folder), V.datasets(spark, folder), SETTINGS)


@query(
    "resolve_decision",
    f"""WITH {DATASETS}, {ARTIFACTS}, {_REQUESTS}, {_JUDGED},
    decided AS (
      SELECT j.*, CASE WHEN a.dataset_id IS NOT NULL THEN 'cached' WHEN reason_code IS NULL THEN 'queued' ELSE 'denied' END AS outcome
      FROM judged j LEFT JOIN artifacts a ON a.dataset_id = j.dataset_id AND a.kind = j.kind AND NOT a.stale)
    SELECT request_id, dataset_id, kind, CASE WHEN coalesce(budget_ms, 0) = 0 THEN 1500 ELSE budget_ms END AS budget_ms,
           CASE WHEN coalesce(row_cap, 0) = 0 THEN 200 ELSE row_cap END AS row_cap, outcome,
           CASE WHEN outcome = 'denied' THEN reason_code END AS reason_code,
           CASE outcome WHEN 'cached' THEN 'cached-' || dataset_id WHEN 'queued' THEN 'new' END AS job_id
    FROM decided""",
)
def resolve_decision(spark, folder):
    decided = P.decide_requests(
        requests(spark, folder), V.artifacts(spark, folder), V.datasets(spark, folder), SETTINGS
    )
    # New job ids are random.
    job = F.when(F.col("outcome") == "queued", "new").otherwise(F.col("job_id"))
    return decided.withColumn("job_id", job)


@query(
    "error_classes",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'timeout'
         WHEN event_type = 'error' AND user_id + 400 = 429 THEN 'rate_limited'
         WHEN event_type = 'error' AND user_id + 400 BETWEEN 500 AND 599 THEN 'network'
         WHEN event_type = 'click' THEN 'network' WHEN event_type = 'view' THEN 'parse_error' ELSE 'unknown' END AS error_class
       FROM events""",
)
def error_classes(spark, folder):
    """Events as fetch outcomes, classified."""
    kind = F.expr(
        "case event_type when 'signup' then 'timeout' when 'error' then 'http' when 'click' then 'transport' "
        "when 'view' then 'parse' else 'other' end"
    )
    outcomes = V.table(spark, folder, "events").select(
        "event_id", kind.alias("error_kind"), (F.col("user_id") + 400).alias("http_status")
    )
    return outcomes.select("event_id", P.error_class().alias("error_class"))


_JOB_COLUMNS = "id, dataset_id, state, CAST(attempts AS INTEGER) AS attempts, epoch_us(started_at) AS started_at"


def _job_columns(jobs):
    return jobs.select("id", "dataset_id", "state", "attempts", F.unix_micros("started_at").alias("started_at"))


@query("stale_leases", f"""WITH {JOBS} SELECT {_JOB_COLUMNS} FROM jobs
WHERE state = 'running' AND started_at < {JOBS_AS_OF} - INTERVAL 30 SECOND AND attempts < 3""")
def stale_leases(spark, folder):
    return _job_columns(H.stale_leases(V.jobs(spark, folder), V.JOBS_AS_OF))


@query("requeue_stale", f"""WITH {JOBS},
marked AS (SELECT *, state = 'running' AND started_at < {JOBS_AS_OF} - INTERVAL 30 SECOND AND attempts < 3 AS lost FROM jobs)
SELECT id, dataset_id, CASE WHEN lost THEN 'queued' ELSE state END AS state, CAST(attempts AS INTEGER) AS attempts,
       CASE WHEN NOT lost THEN epoch_us(started_at) END AS started_at FROM marked""")
def requeue_stale(spark, folder):
    return _job_columns(H.requeue_stale(V.jobs(spark, folder), V.JOBS_AS_OF))


@query("backlog_head", f"""WITH {JOBS} SELECT {_JOB_COLUMNS} FROM jobs WHERE state = 'queued'
ORDER BY enqueued_at NULLS LAST, id LIMIT 50""")
def backlog_head(spark, folder):
    return _job_columns(H.backlog_head(V.jobs(spark, folder), 50))


@query("resolve_p95_merged", ORACLE["resolve_p95"])
def resolve_p95_merged(spark, folder):
    """The p95 of the whole job log out of the sketches of two batches."""
    done = V.jobs(spark, folder).filter("state = 'done'")
    values = done.select("id", micros_between("started_at", "finished_at").alias("us"))
    batch = F.pmod(F.xxhash64("id"), F.lit(2))
    earlier, later = (Q.batch_sketches(values.filter(batch == b), [], "us") for b in range(2))
    sketches = materialised(earlier.unionByName(later), "sketches")
    picked = Q.exact_quantiles(values, sketches, [], "us", "greatest(floor(n * 0.95D), 1)")
    found = picked.agg(F.max("us").alias("us"))
    return found.select(F.coalesce(F.col("us") / 1000, F.lit(0.0)).alias("resolve_p95_ms"))


@query(
    "item_price_medians",
    """SELECT l_suppkey AS supplier, n, cents FROM (
      SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, count(*) OVER (PARTITION BY l_suppkey) AS n,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT)) AS place FROM lineitem)
    WHERE place = greatest(CAST(floor(n * 0.5) AS BIGINT), 1)""",
)
def item_price_medians(spark, folder):
    """The median price of the items of each supplier, from sketches of the items of each return flag."""
    items = V.table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents")
    values = items.select(F.col("l_suppkey").alias("supplier"), "l_returnflag", cents)
    batches = [Q.batch_sketches(values.filter(c), ["supplier"], "cents") for c in ("l_returnflag = 'N'", "l_returnflag is distinct from 'N'")]
    sketches = materialised(batches[0].unionByName(batches[1]), "sketches")
    return Q.exact_quantiles(values, sketches, ["supplier"], "cents", "greatest(floor(n * 0.5D), 1)")
