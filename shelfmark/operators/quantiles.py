"""Exact order statistics out of sketches that merge.

Each batch of values leaves one KLL sketch per key (a Spark built-in): some kilobytes, however many values.
The sketches of all batches merge into a bracket of two values between which the wanted one lies, but for
rare bad luck. A pass over the values counts what lies below the bracket and inside; if the bracket
misses, it moves to the side where the value is. While more than MOST_INSIDE values of a key lie
inside, the same pass leaves a sketch of them, which narrows it. At last the values inside are counted
and the one at the wanted position is picked. So the result is exact, nothing is sorted but brackets,
and a key may hold any share of the values.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialised

# Size of a sketch, and the share of values by which it is trusted to be wrong at most.
SKETCH_K = 2048
MARGIN = 0.002
# Sketches are asked for this many evenly spaced shares.
GRID = 256
# Values of one key that are counted one by one in a task.
MOST_INSIDE = 1_000_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def batch_sketches(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, sketch) of a batch of rows; NULL values are passed over. Append it to those of earlier batches."""
    given = values.filter(F.col(value).isNotNull())
    return given.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), SKETCH_K).alias("sketch"))


def _bracket(share: Column, given: Column) -> tuple[Column, Column]:
    """What a sketch that is given tells of a share of its values: lower and upper end, from a grid of shares."""
    grid = F.when(given, F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
    low, high = F.floor((share - MARGIN) * GRID), F.ceil((share + MARGIN) * GRID)
    return (
        F.when(low >= 1, F.get(grid, F.least(low, F.lit(GRID)).cast("int"))).otherwise(F.lit(_LEAST)),
        F.when(high < GRID, F.get(grid, F.greatest(high, F.lit(0)).cast("int"))).otherwise(F.lit(_MOST)),
    )


def brackets(sketches: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, n, position, low, high): merged from the sketches of all batches; ``position`` is SQL over ``n``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    placed = merged.filter("n > 0").withColumn("position", F.expr(position).cast("bigint"))
    low, high = _bracket(F.try_divide("position", "n"), F.col("n") > 0)
    return placed.select(*keys, "n", "position", low.alias("low"), high.alias("high"))


def _joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the state of their keys, NULL being a key too."""
    names = [f"_key{i}" for i in range(len(keys))]
    state = state.select(*[F.col(key).alias(name) for key, name in zip(keys, names)], *[c for c in state.columns if c not in keys])
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    # Without keys the state is one row.
    return rows.join(state if keys else F.broadcast(state), same).drop(*names)


def _with_brackets(values: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    given = values.select(*keys, F.col(value).cast("bigint").alias("v")).filter("v is not null")
    return _joined(given, state.select(*keys, "low", "high"), keys)


def _counted(values: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The state with the numbers of values below and inside the bracket, and a sketch of those inside."""
    each = _with_brackets(values, state, keys, value)
    inside = F.col("v").between(F.col("low"), F.col("high"))
    facts = each.groupBy(*keys).agg(
        F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(inside).alias("inside"),
        F.kll_sketch_agg_bigint(F.when(inside, F.col("v")), SKETCH_K).alias("sketch"),
    )
    return _joined(facts, state, keys)


def _narrowed(state: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets for the next pass: moved where they missed, narrowed where many values are inside."""
    wanted = F.col("position") - F.col("below")
    low, high = _bracket(F.try_divide(wanted, "inside"), F.col("inside") > 0)
    many = (F.col("inside") > MOST_INSIDE) & (F.col("low") < F.col("high"))
    before, behind = wanted < 1, wanted > F.col("inside")
    return state.select(
        *keys, "n", "position",
        F.when(before, F.lit(_LEAST)).when(behind, F.col("high") + 1).when(many, F.greatest(low, F.col("low"))).otherwise(F.col("low")).alias("low"),
        F.when(before, F.col("low") - 1).when(behind, F.lit(_MOST)).when(many, F.least(high, F.col("high"))).otherwise(F.col("high")).alias("high"),
    )


def exact_quantiles(values: DataFrame, sketches: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, n, value): the exact value at a position (from 1, SQL over ``n``) of each key's sorted values.

    ``sketches`` are those of all batches that make up ``values``; keys without a value have no row.
    """
    state = materialised(brackets(sketches, keys, position), "brackets")
    missed = (F.col("position") <= F.col("below")) | (F.col("position") > F.col("below") + F.col("inside"))
    many = F.col("inside") > MOST_INSIDE
    before = None
    while True:
        counted = materialised(_counted(values, state, keys, value), "bracket-counts")
        facts = counted.agg(F.count_if(missed).alias("missed"), F.coalesce(F.sum(F.when(many, F.col("inside"))), F.lit(0)).alias("many")).first()
        # Many equal values cannot be parted: brackets that do not shrink hold few different ones.
        shrinks = before is None or facts["many"] < before // 2
        if not facts["missed"] and not (facts["many"] and shrinks):
            break
        if not facts["missed"]:
            before = facts["many"]
        state = materialised(_narrowed(counted, keys), "brackets")
    inside = _with_brackets(values, counted, keys, value).filter(F.col("v").between(F.col("low"), F.col("high")))
    counts = inside.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    placed = _joined(counts.withColumn("upto", upto), counted.select(*keys, "n", (F.col("position") - F.col("below")).alias("at")), keys)
    hit = placed.filter((F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("c")))
    return hit.select(*keys, "n", F.col("v").alias(value))
