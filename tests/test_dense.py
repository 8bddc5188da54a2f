import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogs import AS_OF, artifacts, datasets, frame
from shelfmark.operators.catalog import Filters
from shelfmark.plans import dense as D
from shelfmark.workload.dense import DigestEmbedder


def stored(spark, vectors):
    rows = [{"dataset_id": f"ds-{i}", "model": "m", "vector": [float(x) for x in v], "updated_at": AS_OF} for i, v in enumerate(vectors)]
    return frame(spark, "vectors", rows)


def catalog(spark, n, licenses=None):
    return datasets(spark, [{"id": f"ds-{i}", "title": f"T{i}", "license_class": (licenses or ["mit"] * n)[i]} for i in range(n)])


def search(spark, vectors, query, licenses=None, **options):
    table = catalog(spark, len(vectors), licenses)
    return D.search_dense(stored(spark, vectors), table, artifacts(spark, []), query, **options).collect()


def test_order_and_scores(spark):
    hits = search(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0.7071, 0.7071, 0, 0]], [1, 0, 0, 0])
    assert [h.id for h in hits] == ["ds-0", "ds-2", "ds-1"]
    assert [h.score for h in hits] == pytest.approx([1.0, 0.7071, 0.0], abs=1e-4)


def test_paging(spark):
    vectors = [[1, 0], [0.9, 0.1], [0.1, 0.9]]
    assert [h.id for h in search(spark, vectors, [1, 0], limit=1)] == ["ds-0"]
    assert [h.id for h in search(spark, vectors, [1, 0], limit=1, offset=1)] == ["ds-1"]
    assert D.dense_total(stored(spark, vectors), catalog(spark, 3)).first().total == 3


def test_filter(spark):
    vectors, licenses = [[1, 0], [0.9, 0.1], [0.1, 0.9]], ["mit", "apache-2.0", "mit"]
    only = Filters(license_class="apache-2.0")
    assert [h.id for h in search(spark, vectors, [1, 0], licenses, filters=only)] == ["ds-1"]
    assert D.dense_total(stored(spark, vectors), catalog(spark, 3, licenses), only).first().total == 1


def test_ties_go_by_id_and_vectors_without_dataset_are_left_out(spark):
    table = catalog(spark, 3)
    hits = D.search_dense(stored(spark, [[1, 0]] * 5), table, artifacts(spark, []), [1, 0], limit=10).collect()
    assert [h.id for h in hits] == ["ds-0", "ds-1", "ds-2"]


def test_replace(spark):
    vectors = stored(spark, [[1, 0], [0, 1], [0, 1]])
    staged = stored(spark, [[0, 0], [0, 0], [1, 0]]).filter("dataset_id = 'ds-2'")
    new = D.replace_vectors(vectors, staged)
    hits = D.search_dense(new, catalog(spark, 3), artifacts(spark, []), [1, 0], limit=2).collect()
    assert {h.id for h in hits} == {"ds-0", "ds-2"}
    with pytest.raises(Exception, match="duplicate key"):
        D.replace_vectors(vectors, staged.unionByName(staged)).collect()


@pytest.mark.parametrize("bound", [1000, 0])
def test_batch_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "GRID_QUERIES", 3)
    monkeypatch.setattr(D, "GRID_VECTORS", 40)
    rng = np.random.default_rng(1)
    matrix = rng.integers(-2, 3, (120, 4)).astype(float)  # many equal scores
    matrix[matrix.any(axis=1) == 0] = 1
    queries = matrix[:10]
    asked = stored(spark, queries).select(F.col("dataset_id").alias("query_id"), "vector")
    got = D.search_dense_batch(stored(spark, matrix), None, asked, 7, broadcast_queries=bound)
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.dataset_id, row.score))
    for i, q in enumerate(queries):
        scores = matrix @ q
        best = sorted(range(120), key=lambda j: (-scores[j], f"ds-{j}"))[:7]
        assert found[f"ds-{i}"] == [(f"ds-{j}", scores[j]) for j in best]


def test_batch_without_queries(spark):
    vectors = stored(spark, [[1, 0]])
    asked = vectors.select(F.col("dataset_id").alias("query_id"), "vector").filter(F.lit(False))
    assert D.search_dense_batch(vectors, None, asked, 3).count() == 0


def test_status(spark):
    table = catalog(spark, 3)
    assert D.embedding_status(stored(spark, []), table).first().asDict() == {
        "embedded_count": 0, "total_datasets": 3, "model": None}
    assert D.embedding_status(stored(spark, [[1, 0]]), table).first().model == "m"


def embedded(spark, table, vectors, **options):
    return D.embed_catalog(table, vectors, DigestEmbedder(), as_of=AS_OF, **options)


def test_embedding_job_limits_resumes_and_forces(spark):
    table, none = catalog(spark, 3), stored(spark, [])
    assert embedded(spark, datasets(spark, []), none).count() == 0
    first = embedded(spark, table, none, limit=1)
    assert [r.dataset_id for r in first.collect()] == ["ds-0"]
    rest = embedded(spark, table, first)
    assert sorted(r.dataset_id for r in rest.collect()) == ["ds-1", "ds-2"]
    whole = D.replace_vectors(first, rest)
    assert embedded(spark, table, whole).count() == 0
    assert embedded(spark, table, whole, force=True).count() == 3
    assert embedded(spark, table, none, limit=2).count() == 2


def test_embedded_text_finds_itself(spark):
    table = catalog(spark, 3)
    vectors = embedded(spark, table, stored(spark, []))
    text = D.embedding_inputs(table).filter("dataset_id = 'ds-1'").first().text
    query = DigestEmbedder().load()([text])[0].tolist()
    top = D.search_dense(vectors, table, artifacts(spark, []), query, limit=1).first()
    assert top.id == "ds-1" and top.score == pytest.approx(1.0, abs=1e-5)


def test_hashing_embedder_is_unit_length():
    rows = D.HashingEmbedder(16).load()(["a b c a", "", None])
    assert np.linalg.norm(rows[0]) == pytest.approx(1.0)
    assert not rows[1].any() and not rows[2].any()


def test_migration(spark):
    legacy = spark.createDataFrame(
        [("ds-0", "m", "[1.0, 0.0]", None), ("ds-1", "m", "[0, 1]", None), ("ds-2", "m", "[0.5, 0.5]", None)],
        "dataset_id string, model string, embedding string, updated_at timestamp")
    moved = D.migrate_vectors(legacy, stored(spark, []))
    assert D.migration_check(legacy, moved).first().asDict() == {"legacy_count": 3, "new_count": 3, "may_drop": True}
    top = D.search_dense(moved, catalog(spark, 3), artifacts(spark, []), [1, 0], limit=1).first()
    assert top.id == "ds-0"
    broken = legacy.withColumn("embedding", F.lit("no vector"))
    assert not D.migration_check(legacy, D.migrate_vectors(broken, stored(spark, []))).first().may_drop


def test_binary_vectors(spark):
    blob = np.array([0.6, 0.8], dtype="<f4").tobytes()
    legacy = spark.createDataFrame([("ds-0", "m", bytearray(blob), None)], "dataset_id string, model string, vector binary, updated_at timestamp")
    assert D.convert_legacy_vectors(legacy).first().vector == pytest.approx([0.6, 0.8])
