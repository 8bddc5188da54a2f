"""Keyed tables: deduplication, upserts, change detection, staleness.

Reducing to one row per key is an aggregate, not a window: the map side keeps one
row per key and task, so a key that holds a large share of the rows costs nothing
extra in the shuffle.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.times import moment
from shelfmark.schemas import conform


def _pick(df: DataFrame, keys: list[str], chosen) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = chosen(F.struct(*rest))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that comes last in the given order."""
    return _pick(df, keys, lambda row: F.max_by(row, F.struct(*order)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that comes first in the given order."""
    return _pick(df, keys, lambda row: F.min_by(row, F.struct(*order)))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; the job fails if a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return (
        counted.filter(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The base with all rows of the updates put in place by key.

    ``updates`` holds one row per key (see keep_last, require_unique).
    """
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def change_events(base: DataFrame, updates: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """One event per dataset that is new or whose fingerprint differs from the stored one."""
    stored = base.select("id", F.col("fingerprint").alias("_old"), F.lit(True).alias("_known"))
    both = updates.select("id", F.col("fingerprint").alias("_new")).join(stored, "id", "left")
    kind = F.when(F.col("_known").isNull(), "dataset.discovered").when(
        F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")), "dataset.changed"
    )
    return both.select(
        kind.alias("type"),
        F.col("id").alias("dataset_id"),
        F.col("_old").alias("fingerprint_old"),
        F.col("_new").alias("fingerprint_new"),
        moment(as_of).alias("created_at"),
    ).filter(F.col("type").isNotNull())


def as_event_log(events: DataFrame) -> DataFrame:
    """Rows of the event table: what is not a core column goes to the JSON payload."""
    core = ["id", "type", "dataset_id", "created_at"]
    extra = [c for c in events.columns if c not in core]
    present = set(events.columns)
    return conform(
        events.select(
            (F.coalesce("id", F.uuid()) if "id" in present else F.uuid()).alias("id"),
            (F.coalesce("type", F.lit("unknown")) if "type" in present else F.lit("unknown")).alias("type"),
            (F.col("dataset_id") if "dataset_id" in present else F.lit(None)).alias("dataset_id"),
            (F.to_json(F.struct(*extra)) if extra else F.lit("{}")).alias("payload"),
            (
                F.coalesce("created_at", F.current_timestamp())
                if "created_at" in present
                else F.current_timestamp()
            ).alias("created_at"),
        ),
        "events",
    )


def as_signal_log(signals: DataFrame) -> DataFrame:
    """Rows of the signal table, with an id and a time where the input has none."""
    filled = conform(signals, "signals")
    return filled.withColumn("id", F.coalesce("id", F.uuid())).withColumn(
        "created_at", F.coalesce("created_at", F.current_timestamp())
    )


def mark_stale(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """All artifacts of the changed datasets become stale; ``changed`` has a dataset_id column."""
    ids = changed.select("dataset_id").distinct().withColumn("_changed", F.lit(True))
    flagged = artifacts.join(ids, "dataset_id", "left")
    return flagged.withColumn("stale", F.col("stale") | F.col("_changed").isNotNull()).select(*artifacts.columns)


def put_artifacts(artifacts: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(artifacts, require_unique(conform(updates, "artifacts"), ["dataset_id", "kind"]), ["dataset_id", "kind"])


def enqueue_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Job log with the given jobs put in; a job enqueued again starts from a clean state."""
    return upsert(jobs, require_unique(conform(updates, "jobs"), ["id"]), ["id"])


def merge_connectors(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors are replaced; rate limit and back-off state keep the old value when the new one is NULL."""
    new = updates.select(
        "source",
        F.col("cursor").alias("_cursor"),
        F.col("qps_limit").alias("_qps"),
        F.col("backoff_state").alias("_backoff"),
        F.lit(True).alias("_new"),
    )
    return base.join(new, "source", "full_outer").select(
        "source",
        F.when(F.col("_new"), F.col("_cursor")).otherwise(F.col("cursor")).alias("cursor"),
        F.coalesce("_qps", "qps_limit").alias("qps_limit"),
        F.coalesce("_backoff", "backoff_state").alias("backoff_state"),
    )


def put_eval_queries(base: DataFrame, updates: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Queries put in as active; the creation time of a known query stays."""
    known = base.select("id", F.col("created_at").alias("_created"))
    fresh = conform(updates, "eval_queries").join(known, "id", "left")
    fresh = (
        fresh.withColumn("label", F.coalesce("label", F.lit("")))
        .withColumn("total_relevant", F.coalesce("total_relevant", F.lit(1)))
        .withColumn("active", F.lit(True))
        .withColumn("created_at", F.coalesce("_created", moment(as_of)))
        .select(*base.columns)
    )
    return upsert(base, fresh, ["id"])


def set_queries_active(base: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    return (
        base.join(chosen, "id", "left")
        .withColumn("active", F.when(F.col("_chosen"), F.lit(active)).otherwise(F.col("active")))
        .select(*base.columns)
    )


def put_judgments(base: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(base, require_unique(updates, ["query_id", "dataset_id"]), ["query_id", "dataset_id"])


def put_run_results(base: DataFrame, updates: DataFrame) -> DataFrame:
    keys = ["run_id", "query_id", "result_rank"]
    return upsert(base, require_unique(updates, keys), keys)


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of the wanted keys."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")
