"""A bounded bitmap of ids that goes to the texts, where a join on the ids would shuffle the texts.

Built-in functions alone: texts do not leave the JVM for it.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import written

# Bits of the filter for each id, and its least and most bits: 128 KB and 64 MB. For more ids than
# those can tell apart no filter is made, and the join moves the texts.
BITS_PER_ID = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
# Ids in one part of the bitmap.
PART = 1 << 15


def filter_bits(n: int) -> int | None:
    """The bits for so many ids; None if they are too many."""
    bits = LEAST_BITS
    while bits < BITS_PER_ID * n:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def id_filter(ids: DataFrame, kind) -> tuple[DataFrame, int] | None:
    """(part, bits): the bitmap of the first column of ``ids``, taken as ``kind``, and its size; None if too large."""
    key = F.col(ids.columns[0]).cast(kind)
    bits = filter_bits(ids.count())
    if bits is None:
        return None
    place = ids.select(_place(key, bits).alias("place"))
    part, within = F.floor(F.col("place") / PART).alias("part"), F.pmod("place", F.lit(PART))
    return written(place.groupBy(part).agg(F.bitmap_construct_agg(within).alias("bits")), "id-filter"), bits


def may_be_in(rows: DataFrame, ids: DataFrame, key: str = "doc_id", inside: bool = True) -> DataFrame:
    """The rows whose key passes the filter of ``ids``: all that are in it and a few others.

    With ``inside=False`` the rest, of which none is in it. Columns stay as they are. Without a
    filter, because the ids are too many, all rows pass.
    """
    made = id_filter(ids, rows.schema[key].dataType)
    return _passing(rows, made, key, inside)


def _passing(rows: DataFrame, made: tuple[DataFrame, int] | None, key: str, inside: bool) -> DataFrame:
    if made is None:
        return rows if inside else rows.limit(0)
    parts, bits = made
    part, bitmap = f"part-{uuid4().hex}", f"bits-{uuid4().hex}"
    small = F.broadcast(parts.select(F.col("part").alias(part), F.col("bits").alias(bitmap)))
    place = _place(F.col(key), bits)
    within = F.pmod(place, F.lit(PART))
    byte = F.substring(F.col(bitmap), (F.floor(within / 8) + 1).cast("int"), F.lit(1))
    bit = F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(within, F.lit(8)).cast("int"))
    passed = F.coalesce(bit == 1, F.lit(False))
    found = rows.join(small, F.floor(place / PART) == F.col(part), "left")
    return found.filter(passed if inside else ~passed).select(*[rows[c] for c in rows.columns])


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not in ``ids``; only those that pass the filter are joined. Null keys stay."""
    kind = rows.schema[key].dataType
    named = ids.select(F.col(ids.columns[0]).cast(kind).alias(key)).distinct()
    made = id_filter(ids, kind)
    joined = _passing(rows, made, key, True).join(named, key, "left_anti").select(*rows.columns)
    return joined if made is None else _passing(rows, made, key, False).unionByName(joined)
