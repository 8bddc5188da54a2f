"""Keyed tables in buckets: updates that rewrite only what they touch, and joins that move nothing.

Two layouts of plain Parquet, both by a hash of the key:

- folders (``bucket=7/``): an update finds the buckets of its keys, merges those, and puts them
  in the place of the old ones; all other files keep their names and times;
- Spark's own bucketed tables: two tables of equal keys and bucket numbers are joined without an exchange.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from shelfmark.operators.keyed import upsert
from shelfmark.session import materialised

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _whole(df: DataFrame) -> Column:
    """A row as one value that can be compared: maps as their sorted entries."""
    return F.struct(*[F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields])


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write a table to a new folder with a sub-folder per bucket. Keys are unique, so buckets are even."""
    placed = df.withColumn(BUCKET, bucket_of(keys, buckets))
    placed.repartition(buckets, BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table in such a folder, with the columns of ``like``; an empty table has no files."""
    schema = like.withColumn(BUCKET, F.lit(0)).schema
    return spark.read.schema(schema).parquet(path)


def upsert_buckets(path: str, updates: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Put rows, one per key and with the table's columns, into a bucketed folder; the buckets rewritten are returned.

    Rows that are stored already as they come touch nothing. The merged buckets are worked out into the
    shared folder first, so a job that is run again never reads what it has replaced. The work follows
    the buckets touched: choose ``buckets`` so that one is a file or two, and collect updates
    that spread over all keys until they are worth a rewrite.
    """
    spark = updates.sparkSession
    columns = updates.columns
    placed = materialised(updates.withColumn(BUCKET, bucket_of(keys, buckets)), "bucket-updates")
    stored = read_buckets(spark, path, updates)
    # Bounded: one number per bucket.
    named = [r[0] for r in placed.select(BUCKET).distinct().collect()]
    old = stored.filter(F.col(BUCKET).isin(named))
    whole = _whole(updates)
    compared = placed.select(BUCKET, *keys, F.struct(*columns).alias("_row"), whole.alias("_new")).join(
        old.select(BUCKET, *keys, whole.alias("_old"), F.lit(True).alias("_known")), [BUCKET, *keys], "left"
    )
    changed = compared.filter(F.col("_known").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))
    changed = materialised(changed.select("_row.*", BUCKET), "bucket-changes")
    touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
    if touched:
        # The bucket is in the key, so Spark joins within buckets and the layout is kept.
        merged = upsert(old.filter(F.col(BUCKET).isin(touched)).select(*changed.columns), changed, [BUCKET, *keys])
        staged = materialised(merged, "bucket-merged")
        staged.repartition(min(buckets, len(touched)), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def bucketed_table(df: DataFrame, path: str, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """The rows as a Spark table in ``buckets`` sorted files by ``key`` below ``path``, registered under a name.

    A join of two such tables by their keys, or an aggregate by it, needs no exchange.
    """
    name = name or f"bucketed_{uuid4().hex}"
    df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
