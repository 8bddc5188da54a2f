"""Writes: snapshots, append logs and the sample-row store, all as Parquet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keyed import keep_last
from shelfmark.session import materialised


def write_snapshot(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a table to a new folder; a table being read is never overwritten."""
    (df.repartition(partitions) if partitions else df).write.mode("errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append events or signals to a log that is partitioned by day."""
    dated = df.withColumn("day", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("day").parquet(path)


# Rows of one file of the sample-row store, and files that a folder of it is meant to hold.
FILE_ROWS = 1_000_000
FOLDER_FILES = 8


def write_sample_rows(rows: DataFrame, path: str, buckets: int | None = None, order: list[str] | None = None) -> int:
    """Write sample rows so that a dataset's rows lie in one folder; the last of a repeated row_id stays.

    The number of folders (returned, see read_dataset_rows) and of files in each follows from
    the number of rows. Rows of a folder are spread by row_id, so that a dataset with very
    many rows fills many files: its folder is cut by its own number of rows.
    """
    unique = materialised(keep_last(rows, ["row_id"], order or ["sampled_at"]), "sample-rows")
    buckets = buckets or max(1, -(-unique.count() // (FILE_ROWS * FOLDER_FILES)))
    bucket = F.pmod(F.xxhash64("dataset_id"), F.lit(buckets)).cast("int")
    placed = unique.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))
    part = F.pmod(F.xxhash64("row_id"), F.col("_files"))
    (
        placed.join(F.broadcast(sizes), "bucket")
        .withColumn("_part", part)
        .drop("_files")
        .repartition("bucket", "_part")
        .drop("_part")
        .write.mode("errorifexists")
        .partitionBy("bucket")
        .parquet(path)
    )
    return buckets


def read_dataset_rows(rows: DataFrame, dataset_id: str, buckets: int) -> DataFrame:
    """Rows of one dataset out of the sample-row store; reads one folder only."""
    bucket = F.pmod(F.xxhash64(F.lit(dataset_id)), F.lit(buckets)).cast("int")
    return rows.filter((F.col("bucket") == bucket) & (F.col("dataset_id") == dataset_id))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write an evaluation report as CSV or Parquet."""
    writer = df.write.mode("errorifexists")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)
