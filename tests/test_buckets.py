"""Copy-on-write by bucket, joins of bucketed tables, and figures kept by signed changes."""

import datetime
import os
import random
from collections import Counter

import pytest

from shelfmark.operators import rolled as R
from shelfmark.operators.catalog import Filters
from shelfmark.plans import dense as D
from shelfmark.sources import buckets as B
from test_dense import catalog, stored

SCHEMA = "id string, n int, note string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path):
    return sorted(tuple(r)[:3] for r in B.read_buckets(spark, path, spark.createDataFrame([], SCHEMA)).collect())


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "table")
    B.write_buckets(spark.createDataFrame([(f"k{i}", i, None) for i in range(200)], SCHEMA), path, ["id"], 16)
    return path


def test_only_touched_buckets_are_rewritten(spark, store):
    before = files(store)
    updates = spark.createDataFrame([("k7", 70, "new"), ("k7000", 1, None)], SCHEMA)
    touched = B.upsert_buckets(store, updates, ["id"], 16)
    after = files(store)
    gone = {f for f in before if f not in after}
    assert 1 <= len(touched) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in gone} <= set(touched)
    assert all(after[f] == before[f] for f in before if f not in gone) and len(gone) < len(before)
    expected = {f"k{i}": (f"k{i}", i, None) for i in range(200)} | {"k7": ("k7", 70, "new"), "k7000": ("k7000", 1, None)}
    assert rows(spark, store) == sorted(expected.values())


def test_equal_rows_touch_nothing(spark, store):
    before = files(store)
    assert B.upsert_buckets(store, spark.createDataFrame([("k3", 3, None)], SCHEMA), ["id"], 16) == []
    assert B.upsert_buckets(store, spark.createDataFrame([], SCHEMA), ["id"], 16) == []
    assert files(store) == before


def test_updates_of_all_buckets_again_and_again(spark, store):
    for turn in range(2):
        B.upsert_buckets(store, spark.createDataFrame([(f"k{i}", -i - turn, "x") for i in range(100, 300)], SCHEMA), ["id"], 16)
    assert rows(spark, store) == sorted([(f"k{i}", i, None) for i in range(100)] + [(f"k{i}", -i - 1, "x") for i in range(100, 300)])


def test_an_empty_table_takes_updates(spark, tmp_path):
    path = str(tmp_path / "empty")
    B.write_buckets(spark.createDataFrame([], SCHEMA), path, ["id"], 4)
    assert rows(spark, path) == []
    B.upsert_buckets(path, spark.createDataFrame([("a", 1, None)], SCHEMA), ["id"], 4)
    assert rows(spark, path) == [("a", 1, None)]


def test_filtered_search_moves_no_vectors(spark, tmp_path):
    rng = random.Random(1)
    vectors = [[rng.random() for _ in range(4)] for _ in range(60)]
    licenses = [rng.choice(("mit", "other")) for _ in vectors]
    plain = stored(spark, vectors), catalog(spark, 60, licenses)
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, vector array<double>")
    expected = [tuple(r) for r in D.search_dense_batch(*plain, asked, 5, Filters(license_class="mit")).collect()]
    tables = [B.bucketed_table(t, str(tmp_path / key), key, 4) for t, key in zip(plain, ("dataset_id", "id"), strict=True)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = D.search_dense_batch(*tables, asked, 5, Filters(license_class="mit"))
        assert [tuple(r) for r in found.collect()] == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[plan.index("MapInArrow") :].split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in above and "Exchange" not in above and "Bucketed: true" in above


def brute(signals, day):
    counts = Counter(d for d, t in signals if d is not None and t is not None and day - datetime.timedelta(days=6) <= t.date() <= day)
    return dict(counts)


def test_figures_follow_late_signals(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    signals = [(rng.choice(("a", "a", "b", None)), start + datetime.timedelta(hours=rng.randrange(24 * 20))) for _ in range(300)] + [("a", None)]
    path, schema = str(tmp_path / "log"), "dataset_id string, created_at timestamp"
    first, late = signals[:200], signals[200:]
    for _ in range(2):  # the second time changes nothing
        R.commit_changes(path, "first", spark.createDataFrame(first, schema))
    day = lambda n: (start + datetime.timedelta(days=n)).date()
    empty = spark.createDataFrame([], "dataset_id string, n bigint")
    figures = R.advance(empty, R.read_changes(spark, path), None, day(9), [])
    assert {r.dataset_id: r.n for r in figures.collect()} == brute(first, day(9))
    R.commit_changes(path, "late", spark.createDataFrame(late, schema))
    later = R.advance(figures, R.read_changes(spark, path), day(9), day(13), ["first"])
    assert {r.dataset_id: r.n for r in later.collect()} == brute(signals, day(13))
    every = R.rolled(R.read_changes(spark, path)).collect()
    assert every and all(brute(signals, r.day).get(r.dataset_id, 0) == r.n for r in every)
