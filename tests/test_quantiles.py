"""Exact order statistics out of merged sketches against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import quantiles as Q

SCHEMA = "part string, us bigint, batch int"
P95 = "greatest(floor(n * 0.95D), 1)"


def rows():
    rng = random.Random(9)
    out = [("wide", rng.randint(-(10**12), 10**12), i % 2) for i in range(6000)]
    out += [("same", 7, i % 3) for i in range(3000)]
    out += [("two", rng.choice([1, 2]), 0) for _ in range(500)]
    out += [("ends", rng.choice([-(2**63), 2**63 - 1]), 1) for _ in range(50)]
    return [*out, (None, 5, 0), (None, 9, 1), (None, None, 1), ("one", -3, 0), ("void", None, 0)]


def wanted(share):
    held = {}
    for part, us, _ in rows():
        if us is not None:
            held.setdefault(part, []).append(us)
    place = lambda v: max(math.floor(len(v) * share), 1)
    return {part: (len(v), sorted(v)[place(v) - 1]) for part, v in held.items()}


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def in_batches(values, keys):
    parts = [Q.batch_sketches(values.filter(F.col("batch") == b), keys, "us") for b in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.mark.parametrize(("most", "margin"), [(1_000_000, 0.002), (20, 0.002), (20, -0.02)])
@pytest.mark.parametrize("share", [0.95, 0.5])
def test_exact_in_each_group(values, most, margin, share, monkeypatch):
    """Also with brackets that are narrowed several times, and with sketches that miss (a margin below nothing)."""
    monkeypatch.setattr(Q, "MOST_INSIDE", most)
    monkeypatch.setattr(Q, "MARGIN", margin)
    found = Q.exact_quantiles(values, in_batches(values, ["part"]), ["part"], "us", f"greatest(floor(n * {share}D), 1)").collect()
    assert {r.part: (r.n, r.us) for r in found} == wanted(share) and len(found) == len(wanted(share))


def test_without_keys(spark, values):
    whole = sorted(us for _, us, _ in rows() if us is not None)
    found = Q.exact_quantiles(values, in_batches(values, []), [], "us", P95).collect()
    assert [tuple(r) for r in found] == [(len(whole), whole[math.floor(len(whole) * 0.95) - 1])]
    none = spark.createDataFrame([("a", None, 0)], SCHEMA)
    assert Q.exact_quantiles(none, Q.batch_sketches(none, ["part"], "us"), ["part"], "us", P95).count() == 0
    # Without keys a batch without values has an empty sketch.
    assert Q.exact_quantiles(none, in_batches(none, []), [], "us", P95).count() == 0
