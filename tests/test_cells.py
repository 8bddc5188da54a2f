"""Dense search by cells against a search of all vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from shelfmark.plans import cells as PC
from shelfmark.plans import dense as D

SCHEMA = "dataset_id string, vector array<float>"


def stored(kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = centres[rng.integers(0, 20, 800)] + 0.15 * rng.normal(size=(800, 8))
    if kind == "unit":
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    if kind == "lengths":
        rows *= rng.choice([0.01, 0.3, 1.0], size=(800, 1))
    rows[300:560] = rows[300]  # a third of all are copies
    rows[560] = 0
    return [(f"v{i:04}", [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("kind", "cells", "k"), [("unit", 32, 5), ("lengths", 32, 5), ("unit", 1, 3), ("lengths", 100, 300)])
@pytest.mark.parametrize("broadcast_queries", [2048, 10])
def test_cells_give_the_rows_of_a_whole_search(spark, kind, cells, k, broadcast_queries, monkeypatch):
    monkeypatch.setattr(D, "GRID_VECTORS", 100)
    monkeypatch.setattr(D, "GRID_QUERIES", 20)
    rows = stored(kind)
    vectors = spark.createDataFrame([*rows, ("none", None)], SCHEMA).repartition(3)
    rng = np.random.default_rng(6)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(rows[::40])] + [(f"r{i}", rng.normal(size=8).tolist()) for i in range(10)] + [("zero", [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    index = PC.build_cells(vectors, cells)
    found = PC.search_cells(index, queries, k, broadcast_queries=broadcast_queries)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, D.search_dense_batch(vectors, None, queries, k).collect()))


def test_long_vectors(spark):
    """Beyond unit length the last bits of a score depend on the order of summation, so ties are not told by id."""
    rows = [(d, [40 * x for x in v]) for d, v in stored("lengths")]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(rows[::80], "query_id string, vector array<double>")
    scores = lambda hits: [s for *_, s in sorted((h.query_id, h["rank"], h.score) for h in hits.collect())]
    found = scores(PC.search_cells(PC.build_cells(vectors, 32), queries, 20))
    assert len(found) == 200 and found == pytest.approx(scores(D.search_dense_batch(vectors, None, queries, 20)), rel=1e-9)


def test_bounds_hold_and_cells_are_skipped(spark):
    rows = stored("unit")
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = PC.build_cells(vectors, 64)
    queries = spark.createDataFrame([(d, [float(x) for x in v]) for d, v in rows[:40]], "query_id string, vector array<double>")
    best = {}
    for row in index.vectors.collect():
        for name, vector in rows[:40]:
            at = (name, row.cell)
            best[at] = max(best.get(at, -9.0), float(np.dot(np.float64(vector), np.float64(row.vector))))
    for row in PC.cell_bounds(index, queries).collect():
        assert all(c.bound >= best[row.query_id, c.cell] for c in row.reach) and len(row.reach) == index.cells.count()
    _, further = PC.choose_cells(index, index.vectors, queries, 3)
    # Of 40 x some 60 cells beyond the first two.
    assert sum(len(r.cells) for r in further.collect()) < 40 * index.cells.count() / 2


def test_no_vectors_and_no_queries(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    empty = PC.build_cells(spark.createDataFrame([("a", None)], SCHEMA))
    assert PC.search_cells(empty, queries, 3).count() == 0
    some = PC.build_cells(spark.createDataFrame([("a", [1.0, 0.0])], SCHEMA))
    assert PC.search_cells(some, queries.limit(0), 3).count() == 0
    assert [tuple(r) for r in PC.search_cells(some, queries, 3).collect()] == [("q", 1, "a", 1.0)]


def test_rows_of_a_large_search_are_copied_to_few_tasks(spark, monkeypatch):
    """Copies of the vectors must not grow with the number of queries, nor do bounds leave the kernel that works them out."""
    monkeypatch.setattr(D, "GRID_VECTORS", 200)
    monkeypatch.setattr(D, "GRID_QUERIES", 10)
    rows = [(f"v{i:04}", [float(x) for x in v]) for i, v in enumerate(np.float32(np.random.default_rng(8).normal(size=(600, 24))))]
    copies, apply = [], PandasCogroupedOps.applyInArrow

    def counted(self, *args, **named):
        copies.append((self._gd1._df.count(), self._gd2._df.count()))
        return apply(self, *args, **named)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = vectors.selectExpr("dataset_id as query_id", "vector")
    found = PC.search_cells(PC.build_cells(vectors), queries, 4, broadcast_queries=0)
    expected = D.search_dense_batch(vectors, None, queries, 4)
    near = lambda hits: [(h.query_id, h["rank"], h.dataset_id, round(h.score, 9)) for h in hits.collect()]
    assert sorted(near(found)) == sorted(near(expected))
    assert len(copies) == 2 and all(held <= 6 * 600 and asked <= 6 * 600 for held, asked in copies)


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("least", [None, 0.2])
def test_hits_of_blocks_equal_hits_of_all_scores(monkeypatch, single, least):
    """Products in single precision only tell what may be a hit; equal scores go by id, whatever was cut before."""
    monkeypatch.setattr(PC, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(PC, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(PC, "KEPT_HITS", 50)
    monkeypatch.setattr(PC, "SINGLE_LENGTH", 1e15 if single else 0)
    monkeypatch.setattr(PC, "SINGLE_SHARE", 1.0)
    rows = stored("unit")
    rng = np.random.default_rng(9)
    cells = rng.integers(0, 11, len(rows))
    wanted = rng.random((40, 13)) < 0.7
    lists = lambda some: pa.array([v for _, v in some], pa.list_(pa.float32()))
    asked = pa.table({"vector": lists(rows[::20]), "wanted": PC._bits(wanted), "least": pa.array([least] * 40, pa.float64())})
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), lists(rows), pa.array(cells * 3, pa.int32())], ["dataset_id", "vector", "cell"])
    best = PC._Best(asked, 6, 2, np.arange(11) * 3)
    for start in range(0, len(rows), 90):
        best.add(batch.slice(start, 90))
    scores = np.round(np.float64([v for _, v in rows[::20]]) @ np.float64([v for _, v in rows]).T, D.SCORE_DECIMALS)
    expected = []
    for q in range(40):
        hits = sorted((-scores[q, i], d) for i, (d, _) in enumerate(rows) if wanted[q, 2 + cells[i]] and (least is None or scores[q, i] >= least))
        expected += [(q, d, -s) for s, d in hits[:6]]
    got = best.cut()
    assert [(q, d) for q, d, _ in expected] == list(zip(got[0].tolist(), got[2].tolist()))
    assert got[1] == pytest.approx([s for *_, s in expected], abs=1e-11)


def test_a_shuffle_by_spread_numbers_is_even(spark):
    numbers = PC._spread(spark, 10)
    assert len(set(numbers)) == 10
    shares = spark.createDataFrame([(n,) for n in numbers], "n bigint").selectExpr("pmod(hash(n), 4) as s").groupBy("s").count().collect()
    assert sorted(r["count"] for r in shares) == [2, 2, 3, 3]
