"""Mixing sources to target weights: whole copies at each source's rate, and one seeded draw for the rest."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.texts import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def text_size(text: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: source_size, target and rate.

    ``sizes`` has source and size. Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` of all sizes. A target stops at ``most`` times
    its source's size, and the excess goes to the others by weight: with the sources in
    order of cap per weight, the level is where the capped ones end. One row per source
    meets in one task, after a partial sum of each. A source without words has target and rate 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("_level", level)
    fits = F.col("_level") <= F.col("cap") / F.col("weight")
    ranked = sources.withColumn("_fits", fits).withColumn("_place", F.row_number().over(order))
    first = F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(whole)["_level"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), first * F.col("weight")), F.col("cap").cast("double"))
    ranked = ranked.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: str = "rate", doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """floor(rate) copies and one more with the probability of the fraction, drawn by the hash of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + F.when(draw < F.col(rate) - whole, 1).otherwise(0)).cast("bigint")


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with their source's columns; null is a source like others. A source with a
    large share of the rows is split by adaptive execution, its side is one row."""
    named = rates.withColumnRenamed("source", "_source")
    return rows.join(named, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, rate, copies and taken (size times copies).

    Empty or null texts have size 0 and take 0; null and repeated doc_ids are rows like
    others (equal ids draw alike); other columns are not read. An empty table gives no rows.
    """
    sizes = written(docs.select("doc_id", "source", text_size().alias("size")), "sizes")
    mixed = with_rates(sizes, source_rates(sizes, **options)).withColumn("copies", copies())
    return mixed.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, repeated ones as often as they are taken, with the columns of ``docs``."""
    names = docs.columns
    sizes = docs.select("source", text_size().alias("size"))
    rates = written(source_rates(sizes, **options), "rates").select("source", "rate")
    taken = with_rates(docs, rates.withColumnRenamed("rate", "_rate"))
    taken = taken.withColumn("_copies", copies("_rate")).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)


MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes GROUP BY source),
ordered AS (
  SELECT source, source_size, weight, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
         row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS place FROM sources),
levels AS (
  SELECT o.place, o.ratio,
         (1.5 * (SELECT sum(source_size) FROM sources)
          - coalesce((SELECT sum(b.cap) FROM ordered b WHERE b.place < o.place), 0))
         / (SELECT sum(r.weight) FROM ordered r WHERE r.place >= o.place) AS level
  FROM ordered o),
cut AS (SELECT CAST(arg_min(level, place) AS DOUBLE) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), cut.level * weight), CAST(cap AS DOUBLE)) AS target
  FROM ordered LEFT JOIN cut ON true),
rated AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target, rate,
       CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
                                    / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
                                    / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sizes JOIN rated ON sizes.source IS NOT DISTINCT FROM rated.source"""
