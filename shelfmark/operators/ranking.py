"""Top-k, paging and exact order statistics without a global sort."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialised


# A page that ends within this many rows is cut by a merge of each task's first rows.
DRIVER_ROWS = 10_000


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order.

    For pages further down the rows are sorted by range and kept in the shared folder; the
    numbers of rows per part tell which parts hold the page, and only those are read.
    """
    if offset < 0 or limit < 0:
        raise ValueError("limit and offset must not be negative")
    ordered = df.orderBy(*order)
    if offset + limit <= DRIVER_ROWS:
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    rows = materialised(placed, "sorted").withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    wanted, before = F.lit(False), 0
    for part, count in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        low, high = offset - before, offset + limit - before
        if low < count and high > 0:
            wanted = wanted | ((F.col("_part") == part) & (F.col("_place") >= low) & (F.col("_place") < high))
        before += count
    return rows.filter(wanted).drop("_part", "_place")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group, ranked from 1.

    Every task cuts its share of a group to k rows before the shuffle
    (WindowGroupLimit in the plan), so a large group stays small on the wire.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def nth_smallest(df: DataFrame, value: str, position: str, times: str | None = None) -> DataFrame:
    """The exact n-th smallest (from 1) of a bigint column, as one row; NULL if there are no values.

    ``position`` is SQL over ``n``, the number of values; ``times`` names a column that
    tells how often a row's value occurs. Rows are counted per distinct value first, which
    is kept in the shared folder, so that the input is read once. The value is then found 22 bits at a time: each step sorts the counts of
    at most 2^22 value ranges in one task, however many rows there are, and the next step
    reads only the range that was hit.
    """
    each = F.sum(times) if times else F.count("*")
    counts = materialised(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(each.alias("c")), "counts")
    ordered, whole = Window.orderBy("p"), Window.partitionBy()
    state = None
    for shift in (44, 22, 0):
        step = counts if state is None else counts.join(F.broadcast(state), F.shiftright("v", shift + 22) == state["prefix"])
        carried = [] if state is None else ["want"]
        sums = step.groupBy(F.shiftright("v", shift).alias("p"), *carried).agg(F.sum("c").alias("c"))
        if state is None:
            sums = sums.withColumn("n", F.sum("c").over(whole)).withColumn("want", F.expr(f"cast({position} as bigint)"))
        upto = sums.withColumn("upto", F.sum("c").over(ordered))
        hit = upto.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
        state = hit.select(
            F.col("p").alias("prefix"), (F.col("want") - (F.col("upto") - F.col("c"))).alias("want")
        )
    return state.agg(F.max("prefix").alias(value))
