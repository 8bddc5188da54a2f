"""Counts and shares over the catalog and its job log."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.times import before, micros_between, moment
from shelfmark.operators.catalog import fresh_artifact, fresh_schema_ids, thin_readme
from shelfmark.operators.ranking import nth_smallest
from shelfmark.session import materialised


def _counted(jobs: DataFrame) -> DataFrame:
    """Job rows, or a histogram of them, with the number of jobs a row stands for."""
    return jobs if "jobs" in jobs.columns else jobs.withColumn("jobs", F.lit(1).cast("bigint"))


def job_states(jobs: DataFrame) -> DataFrame:
    return _counted(jobs).groupBy("state").agg(F.sum("jobs").alias("jobs"))


def error_taxonomy(jobs: DataFrame) -> DataFrame:
    return _counted(jobs).filter(F.col("error_class").isNotNull()).groupBy("error_class").agg(F.sum("jobs").alias("jobs"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    queued = _counted(jobs).filter(F.col("state") == "queued")
    return queued.agg(F.coalesce(F.sum("jobs"), F.lit(0).cast("bigint")).alias("queue_depth"))


def job_histogram(jobs: DataFrame) -> DataFrame:
    """(state, error_class, us, jobs): the log counted in one pass, with the durations of jobs that are done.

    All figures of the log follow from it. It is kept in the shared folder.
    """
    us = F.when(F.col("state") == "done", micros_between("started_at", "finished_at"))
    return materialised(jobs.groupBy("state", "error_class", us.alias("us")).agg(F.count("*").alias("jobs")), "jobs")


def resolve_p95(jobs: DataFrame) -> DataFrame:
    """One row: the element at position max(floor(0.95 n), 1) of the sorted durations, in ms; 0 if none."""
    return p95_of(job_histogram(jobs))


def p95_of(histogram: DataFrame) -> DataFrame:
    picked = nth_smallest(histogram, "us", "greatest(floor(n * 0.95D), 1)", "jobs")
    return picked.select(F.coalesce(F.col("us") / 1000, F.lit(0.0)).alias("resolve_p95_ms"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def catalog_shares(datasets: DataFrame, artifacts: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """One row: fresh, thin and schema-covered shares of the catalog, in one pass over it."""
    fresh = fresh_schema_ids(artifacts).withColumn("_schema", F.lit(True))
    facts = datasets.select("id", "indexed_at", "readme_tokens", "readme_score", "access_class")
    joined = facts.join(fresh, facts["id"] == fresh["dataset_id"], "left")
    public = F.col("access_class") == "public"
    counted = joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("indexed_at") >= before(moment(as_of), days=1)).alias("fresh"),
        F.count_if(thin_readme()).alias("thin"),
        F.count_if(public).alias("public"),
        F.count_if(public & F.col("_schema").isNotNull()).alias("covered"),
    )
    return counted.select(
        _percent(F.col("fresh"), F.col("total")).alias("freshness_pct"),
        _percent(F.col("thin"), F.col("total")).alias("thin_readme_pct"),
        F.greatest(F.col("public") - F.col("covered"), F.lit(0)).alias("public_no_schema_count"),
        _percent(F.col("covered"), F.col("public")).alias("public_with_schema_pct"),
    )


def signal_counts(signals: DataFrame, as_of: Column | datetime | str | None = None, days: int = 7) -> DataFrame:
    """Signals per dataset in the days before ``as_of``."""
    recent = signals.filter(F.col("created_at") >= before(moment(as_of), days=days))
    return recent.groupBy("dataset_id").agg(F.count("*").alias("sig_score"))


def dataset_state(
    datasets: DataFrame, artifacts: DataFrame, jobs: DataFrame, as_of: Column | datetime | str | None = None
) -> DataFrame:
    """Per dataset 0/1 flags: fresh schema, fresh snippets, job errors of the last seven days.

    Artifacts and jobs are reduced to one row per dataset before the joins, so that
    neither multiplies the other.
    """
    asked = moment(as_of)
    have = artifacts.groupBy("dataset_id").agg(
        F.max(fresh_artifact("schema").cast("int")).alias("has_schema"),
        F.max(fresh_artifact("snips").cast("int")).alias("has_snips"),
    )
    failed = (
        jobs.filter((F.col("state") == "error") & (F.col("enqueued_at") > before(asked, days=7)))
        .select("dataset_id")
        .distinct()
        .withColumn("recent_errors", F.lit(1))
    )
    ids = datasets.select(F.col("id").alias("dataset_id"))
    joined = ids.join(have, "dataset_id", "left").join(failed, "dataset_id", "left")
    return joined.select(
        F.col("dataset_id").alias("id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("has_schema", "has_snips", "recent_errors")],
        asked.alias("last_refreshed_at"),
    )
