"""Counts over the last days, kept up to date by signed daily changes.

A signal of a day adds one to the figures from that day on and takes it back when it leaves the
window. So the changes of a day are its count less the count of the day that leaves, and the figure of a
day is that of the day before with its changes. Late signals are changes of their own days: they
are added to figures already made. Nothing is counted twice, and no old signal is read again.
"""

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialised

WINDOW_DAYS = 7


def signed_changes(signals: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(day, dataset_id, change) of a batch of signals: counted per day before anything is shuffled.

    Signals without a dataset or a time are in no figure.
    """
    known = signals.filter(F.col("dataset_id").isNotNull() & F.col("created_at").isNotNull())
    daily = known.groupBy(F.to_date("created_at").alias("day"), "dataset_id").agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct("day", F.col("n").alias("change")), F.struct(F.date_add("day", days).alias("day"), (-F.col("n")).alias("change"))))
    return daily.select("dataset_id", both.alias("c")).groupBy("c.day", "dataset_id").agg(F.sum("c.change").alias("change"))


def commit_changes(path: str, batch: str, signals: DataFrame, days: int = WINDOW_DAYS) -> None:
    """Add the changes of a batch to the log below ``path``; a batch that is sent again replaces itself."""
    rows = materialised(signed_changes(signals, days).withColumn("batch", F.lit(batch)), "signal-changes")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_changes(spark, path: str) -> DataFrame:
    return spark.read.schema("day date, dataset_id string, change bigint, batch string").parquet(path)


def rolled(changes: DataFrame) -> DataFrame:
    """(day, dataset_id, n): the figure of each day on which something came or left; it stays until the next one.

    A dataset has at most one row per day here, however many signals it has.
    """
    daily = changes.groupBy("day", "dataset_id").agg(F.sum("change").alias("change"))
    so_far = Window.partitionBy("dataset_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", "dataset_id", F.sum("change").over(so_far).alias("n"))


def advance(figures: DataFrame, changes: DataFrame, old_day: date | None, new_day: date, batches: list[str]) -> DataFrame:
    """(dataset_id, n) of ``new_day`` from the figures of ``old_day``, which were made from these batches.

    Of batches the figures have seen, only the days since are added; of others, which came late, all days.
    """
    until = changes.filter(F.col("day") <= F.lit(new_day))
    if old_day is not None and batches:
        until = until.filter((F.col("day") > F.lit(old_day)) | ~F.col("batch").isin(batches))
    both = figures.select("dataset_id", F.col("n").alias("change")).unionByName(until.select("dataset_id", "change"))
    return both.groupBy("dataset_id").agg(F.sum("change").alias("n")).filter("n <> 0")
