"""Connected components of links by alternating stars, all of it in joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (columns a, b); component_id is the smallest id reached.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour, so
    the number of rounds grows with the logarithm of the longest path. A hub with many
    neighbours is reduced to its minimum before the shuffle and is split in the join
    by adaptive execution. Null ids are dropped, links to itself give a component of one.
    Every round is a table in the shared folder, so a lost executor costs one round.
    """
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*")
        edges = written(small.filter("u > v").distinct(), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return ids.join(edges.select(F.col("u").alias("id"), F.col("v").alias("_low")), "id", "left").select(
        "id", F.coalesce("_low", "id").alias("component_id")
    )
