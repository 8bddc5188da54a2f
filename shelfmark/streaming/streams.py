"""Incremental forms: listing intake, request resolution, windowed signal counts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.schemas import TABLES
from shelfmark.session import checkpoint_folder


def stream_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Rows of a Parquet log of one of the fixed tables, as they arrive."""
    return spark.readStream.schema(T.StructType.fromDDL(TABLES[table])).parquet(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (value) of a landing folder, as files arrive."""
    return spark.readStream.text(path)


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Hand all input not yet seen to ``handle`` in batches, then stop.

    The checkpoint folder (by default one of that name in the session's shared folder)
    keeps the place reached, as a stored cursor would. ``handle`` gets the batch number,
    so that a batch run again can replace its first result.
    """
    folder = checkpoint or f"{checkpoint_folder(stream.sparkSession)}/{name}"
    return (
        stream.writeStream.queryName(name)
        .foreachBatch(handle)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events or signals with each id once, for repeats no later than ``lateness``."""
    return log.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])


def windowed_signal_counts(signals: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Signals per dataset in windows of seven days that move by one day.

    Works on streams and on tables. Later rows than ``lateness`` are dropped by a stream.
    """
    timed = signals.withWatermark("created_at", lateness)
    counts = timed.groupBy(F.window("created_at", "7 days", "1 day"), "dataset_id").agg(
        F.count("*").alias("sig_score")
    )
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "dataset_id", "sig_score",
    )
