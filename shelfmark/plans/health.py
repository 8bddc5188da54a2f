"""Operational reports: admin metrics, prefetch ranking, job-log checks."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.times import before, moment
from shelfmark.operators import metrics as M
from shelfmark.operators.catalog import fresh_schema_ids, signal_of, thin_readme
from shelfmark.operators.policy import PolicySettings, pause_reason
from shelfmark.operators.ranking import page
from shelfmark.schemas import conform


def _as_text(counts: DataFrame, name: str) -> Column:
    """Counts per label as one JSON object of all labels, which are classes of errors or states of jobs."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name), F.col("jobs"))))
    return counts.filter(F.col(name).isNotNull()).agg(F.to_json(F.map_from_entries(pairs))).scalar()


def admin_metrics(
    datasets: DataFrame,
    artifacts: DataFrame,
    jobs: DataFrame,
    as_of: Column | datetime | str | None = None,
    settings: PolicySettings = PolicySettings(),
) -> DataFrame:
    """One row with all health figures and whether prefetching is paused."""
    shares, log = M.catalog_shares(datasets, artifacts, as_of), M.job_histogram(jobs)
    row = shares.select(
        "*",
        M.p95_of(log).scalar().alias("resolve_p95_ms"),
        M.queue_depth(log).scalar().alias("queue_depth"),
        _as_text(M.error_taxonomy(log), "error_class").alias("error_taxonomy"),
        _as_text(M.job_states(log), "state").alias("jobs_by_state"),
    )
    row = row.withColumn("prefetch_reason", pause_reason(settings))
    return row.withColumn("prefetch_paused", F.col("prefetch_reason").isNotNull())


def should_pause(jobs: DataFrame, settings: PolicySettings = PolicySettings()) -> DataFrame:
    """One row: resolve_p95_ms, queue_depth, prefetch_paused, prefetch_reason."""
    log = M.job_histogram(jobs)
    row = M.p95_of(log).select("resolve_p95_ms", M.queue_depth(log).scalar().alias("queue_depth"))
    row = row.withColumn("prefetch_reason", pause_reason(settings))
    return row.withColumn("prefetch_paused", F.col("prefetch_reason").isNotNull())


def prefetch_candidates(
    datasets: DataFrame,
    artifacts: DataFrame,
    signals: DataFrame,
    limit: int,
    as_of: Column | datetime | str | None = None,
) -> DataFrame:
    """Public datasets with a thin README and no fresh schema, most used first."""
    thin = datasets.filter((F.col("access_class") == "public") & thin_readme()).select(
        F.col("id").alias("dataset_id"), signal_of("downloads").alias("downloads"), "last_seen_lm"
    )
    ranked = (
        thin.join(fresh_schema_ids(artifacts), "dataset_id", "left_anti")
        .join(M.signal_counts(signals, as_of), "dataset_id", "left")
        .withColumn("sig_score", F.coalesce("sig_score", F.lit(0)))
    )
    order = [
        F.col("sig_score").desc(),
        F.col("downloads").desc_nulls_last(),
        F.col("last_seen_lm").desc_nulls_last(),
        F.col("dataset_id").asc(),
    ]
    return page(ranked, order, limit)


def prefetch_jobs(
    candidates: DataFrame, as_of: Column | datetime | str | None = None, settings: PolicySettings = PolicySettings()
) -> DataFrame:
    """Queued schema jobs for the candidates, one per dataset under a fixed id."""
    return conform(
        candidates.select(
            F.concat(F.lit("prefetch-"), "dataset_id").alias("id"),
            "dataset_id",
            F.lit("schema").alias("kind"),
            F.lit("queued").alias("state"),
            F.lit(0).alias("attempts"),
            F.lit(settings.budget_ms).alias("budget_ms"),
            F.lit(settings.row_cap).alias("row_cap"),
            moment(as_of).alias("enqueued_at"),
        ),
        "jobs",
    )


def _lease_lost(as_of: Column, timeout_s: float, max_attempts: int) -> Column:
    if timeout_s <= 0:
        return F.lit(False)
    return F.coalesce(
        (F.col("state") == "running")
        & (F.col("started_at") < before(as_of, seconds=timeout_s))
        & (F.col("attempts") < max_attempts),
        F.lit(False),
    )


def stale_leases(
    jobs: DataFrame,
    as_of: Column | datetime | str | None = None,
    timeout_s: float = C.LEASE_TIMEOUT_SECONDS,
    max_attempts: int = C.LEASE_MAX_ATTEMPTS,
) -> DataFrame:
    """Running jobs that started too long ago and may be tried again."""
    return jobs.filter(_lease_lost(moment(as_of), timeout_s, max_attempts))


def requeue_stale(
    jobs: DataFrame,
    as_of: Column | datetime | str | None = None,
    timeout_s: float = C.LEASE_TIMEOUT_SECONDS,
    max_attempts: int = C.LEASE_MAX_ATTEMPTS,
) -> DataFrame:
    """The job log with stale leases queued again; attempts and error columns stay."""
    lost = _lease_lost(moment(as_of), timeout_s, max_attempts)
    marked = jobs.withColumn("_lost", lost)
    for column in ("started_at", "finished_at"):
        marked = marked.withColumn(column, F.when(~F.col("_lost"), F.col(column)))
    marked = marked.withColumn("state", F.when(F.col("_lost"), "queued").otherwise(F.col("state")))
    return marked.select(*jobs.columns)


def backlog_head(jobs: DataFrame, n: int) -> DataFrame:
    """The n queued jobs that wait longest."""
    waiting = jobs.filter(F.col("state") == "queued")
    return page(waiting, [F.col("enqueued_at").asc_nulls_last(), F.col("id").asc()], n)
