"""Dense numbers for rows: 0 to n - 1, each once, without a sort and without moving a row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.session import materialised

_ROW_BITS = 33


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """The rows with their numbers, as tables in the shared folder.

    The rows are written once with their part and place in it. The counts per part, one row
    each, are summed up to the number at which a part begins; that is added where the rows lie.
    Reading the result again gives the same numbers. Rows of one part have neighbouring numbers.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    placed = materialised(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, _ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    begins = materialised(counts.select("_part", before.alias("_begin")), "number-begins")
    place = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per part of the input: of some bytes, for as many parts as there are tasks.
    out = placed.join(F.broadcast(begins), part == F.col("_part"))
    return out.select(*[c for c in df.columns], (F.col("_begin") + place).alias(name))
