"""Dense search and embedding queries."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark import views as V
from shelfmark.functions import vectors as VF
from shelfmark.operators.catalog import Filters
from shelfmark.plans import cells as PC
from shelfmark.plans import dense as D
from shelfmark.workload.registry import ARTIFACTS, AS_OF, DATASETS, NOT_SPACE, ORACLE, VECTORS, query

DIMENSIONS = 64
QUERY_VECTOR = [0.125] * DIMENSIONS
FILTERS = Filters(license_class="mit", language="en")
_FILTER_SQL = "AND license_class = 'mit' AND languages LIKE '%en%'"
_SCORED = "scored AS (SELECT dataset_id, round(list_sum(vector) * 0.125, 12) AS score FROM vectors)"
_HEAD = f"WITH {DATASETS}, {ARTIFACTS}, {VECTORS}, {_SCORED}"
_HIT = """
SELECT d.id, d.title, round(s.score, 6) AS score, f.dataset_id IS NOT NULL AS has_schema, d.readme_text
FROM scored s JOIN datasets d ON d.id = s.dataset_id LEFT JOIN fresh f ON f.dataset_id = d.id WHERE true"""


class DigestEmbedder:
    """Deterministic stand-in for a model: the first eight bytes of a text's SHA-256, scaled to unit length."""

    name = "digest-8"

    def load(self):
        def embed(texts):
            heads = [hashlib.sha256(t.encode("utf-8")).digest()[:8] for t in texts]
            rows = np.array([list(h) for h in heads], dtype=float).reshape(-1, 8) / 255
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            return rows / np.where(norms > 0, norms, 1.0)

        return embed


def _tables(spark, folder):
    return V.vectors(spark, folder), V.datasets(spark, folder), V.artifacts(spark, folder)


def _shown(hits):
    return hits.select("id", "title", F.round("score", 6).alias("score"), "has_schema", "readme_text")


@query("dense_topk", f"{_HEAD} {_HIT} ORDER BY s.score DESC, d.id LIMIT 30")
def dense_topk(spark, folder):
    return _shown(D.search_dense(*_tables(spark, folder), QUERY_VECTOR))


@query("dense_topk_filtered", f"{_HEAD} {_HIT} {_FILTER_SQL} ORDER BY s.score DESC, d.id LIMIT 30")
def dense_topk_filtered(spark, folder):
    return _shown(D.search_dense(*_tables(spark, folder), QUERY_VECTOR, FILTERS))


@query("dense_page2", f"{_HEAD} {_HIT} ORDER BY s.score DESC, d.id LIMIT 20 OFFSET 20")
def dense_page2(spark, folder):
    return _shown(D.search_dense(*_tables(spark, folder), QUERY_VECTOR, limit=20, offset=20))


@query("dense_total", f"{_HEAD} SELECT count(*) AS total FROM ({_HIT} {_FILTER_SQL})")
def dense_total(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return D.dense_total(vectors, datasets, FILTERS)


@query("dense_scores", f"{_HEAD} SELECT dataset_id, round(score, 6) AS score FROM scored")
def dense_scores(spark, folder):
    """Scores by built-in expressions, without Python."""
    asked = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    vectors = V.vectors(spark, folder)
    return vectors.select("dataset_id", F.round(VF.dot("vector", asked), 6).alias("score"))


_TOP = """
SELECT query_id, rank, dataset_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset_id) AS INTEGER) AS rank
  FROM pairs)
WHERE rank <= {k}"""
_CENTRES = f"""
parts AS (SELECT label, unnest(range(1, {DIMENSIONS + 1})) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
centres AS (SELECT CAST(label AS VARCHAR) AS query_id, list(x / norm ORDER BY pos) AS q
            FROM means JOIN (SELECT label, sqrt(sum(x * x)) AS norm FROM means GROUP BY 1) USING (label) GROUP BY 1)"""


def _rounded(hits):
    return hits.withColumn("score", F.round("score", 6))


def centres(spark, folder):
    """One query per label: the mean of its vectors, scaled to unit length."""
    parts = V.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda part: part.x)
    return means.groupBy(F.col("label").cast("string").alias("query_id")).agg(
        VF.l2_normalize(vector).alias("vector")
    )


@query(
    "dense_topk_batch",
    f"""WITH {DATASETS}, {VECTORS}, {_CENTRES},
    pairs AS (SELECT query_id, dataset_id, round(list_dot_product(vector, q), 12) AS score
              FROM vectors JOIN datasets ON id = dataset_id, centres)
    {_TOP.format(k=10)}""",
)
def dense_topk_batch(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return _rounded(D.search_dense_batch(vectors, datasets, centres(spark, folder), 10))


@query(
    "dense_topk_batch_filtered",
    f"""WITH {DATASETS}, {VECTORS}, {_CENTRES},
    pairs AS (SELECT query_id, dataset_id, round(list_dot_product(vector, q), 12) AS score
              FROM vectors JOIN datasets ON id = dataset_id, centres WHERE true {_FILTER_SQL})
    {_TOP.format(k=10)}""",
)
def dense_topk_batch_filtered(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return _rounded(D.search_dense_batch(vectors, datasets, centres(spark, folder), 10, FILTERS))


_NEIGHBOURS = f"""WITH {VECTORS},
pairs AS (SELECT q.dataset_id AS query_id, v.dataset_id, round(list_dot_product(v.vector, q.vector), 12) AS score
          FROM vectors v, vectors q)
{_TOP.format(k=5)}"""


@query("dense_neighbours", _NEIGHBOURS)
def dense_neighbours(spark, folder):
    """The five nearest vectors of every vector."""
    vectors = V.vectors(spark, folder)
    asked = vectors.select(F.col("dataset_id").alias("query_id"), "vector")
    return _rounded(D.search_dense_batch(vectors, None, asked, 5))


@query("dense_neighbours_grid", _NEIGHBOURS)
def dense_neighbours_grid(spark, folder):
    """The same by the grid that large query sets go through."""
    vectors = V.vectors(spark, folder)
    asked = vectors.select(F.col("dataset_id").alias("query_id"), "vector")
    return _rounded(D.search_dense_batch(vectors, None, asked, 5, broadcast_queries=0))


@query(
    "vector_normalize",
    f"""WITH {VECTORS}, scaled AS (SELECT dataset_id, list_transform(vector, lambda x: x * 3) AS v FROM vectors)
    SELECT dataset_id, unnest(range({DIMENSIONS})) AS at,
           round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS x FROM scaled""",
)
def vector_normalize(spark, folder):
    scaled = V.vectors(spark, folder).select(
        "dataset_id", F.transform("vector", lambda x: x.cast("double") * 3).alias("vector")
    )
    parts = scaled.select("dataset_id", F.posexplode(VF.l2_normalize("vector")).alias("at", "x"))
    return parts.select("dataset_id", F.col("at").cast("bigint").alias("at"), F.round("x", 6).alias("x"))


@query("embedding_status", """SELECT (SELECT count(*) FROM embeddings) AS embedded_count,
       (SELECT count(*) FROM documents) AS total_datasets, 'given-64' AS model""")
def embedding_status(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return D.embedding_status(vectors, datasets)


@query("vector_signature", f"SELECT count(*) AS vectors, epoch_us({AS_OF}) AS last_update FROM embeddings")
def vector_signature(spark, folder):
    return D.vector_signature(V.vectors(spark, folder)).select(
        "vectors", F.unix_micros("last_update").alias("last_update")
    )


_INPUTS = """inputs AS (
  SELECT id AS dataset_id, concat_ws(' ', title, description, readme_text, tags, coalesce(modalities, ''), languages) AS text
  FROM datasets)"""


@query("embedding_resume_inputs", f"""WITH {DATASETS}, {VECTORS}, {_INPUTS}
SELECT dataset_id, text FROM inputs WHERE dataset_id NOT IN (SELECT dataset_id FROM vectors)""")
def embedding_resume_inputs(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return D.pending_inputs(datasets, vectors)


_BYTES = ", ".join(f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) / 255.0" for i in range(8))


@query(
    "embed_digest",
    f"""WITH {DATASETS}, {_INPUTS}, heads AS (SELECT dataset_id, sha256(text) AS h FROM inputs),
    raw AS (SELECT dataset_id, [{_BYTES}]::DOUBLE[] AS v FROM heads)
    SELECT dataset_id, 'digest-8' AS model, unnest(range(8)) AS at,
           round(CAST(CAST(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS FLOAT) AS DOUBLE), 5) AS x
    FROM raw""",
)
def embed_digest(spark, folder):
    """The embedding job with the deterministic stand-in, over the whole catalog."""
    vectors, datasets, _ = _tables(spark, folder)
    done = D.embed_catalog(datasets, vectors, DigestEmbedder(), force=True, as_of=V.CATALOG_AS_OF)
    parts = done.select("dataset_id", "model", F.posexplode_outer("vector").alias("at", "x"))
    return parts.select(
        "dataset_id", "model", F.col("at").cast("bigint").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


@query(
    "embed_hash",
    f"""WITH {DATASETS}, {_INPUTS},
    tokens AS (SELECT dataset_id, unnest(regexp_extract_all(lower(text), '{NOT_SPACE}')) AS token FROM inputs),
    codes AS (SELECT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS code FROM (SELECT DISTINCT token FROM tokens)),
    places AS (SELECT dataset_id, (code // 2) % 384 AS at_dim, sum(CASE WHEN code % 2 = 1 THEN 1 ELSE -1 END) AS x
               FROM tokens JOIN codes USING (token) GROUP BY ALL),
    norms AS (SELECT dataset_id, sqrt(sum(x * x)) AS norm FROM places GROUP BY 1)
    SELECT dataset_id, 'token-hash-384' AS model, CAST(at_dim AS BIGINT) AS at,
           round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 5) AS x
    FROM places JOIN norms USING (dataset_id) WHERE x <> 0""",
)
def embed_hash(spark, folder):
    """The embedding job with the built-in embedder, over the whole catalog."""
    vectors, datasets, _ = _tables(spark, folder)
    done = D.embed_catalog(datasets, vectors, force=True, as_of=V.CATALOG_AS_OF)
    parts = done.select("dataset_id", "model", F.posexplode_outer("vector").alias("at", "x")).filter("x <> 0")
    return parts.select(
        "dataset_id", "model", F.col("at").cast("bigint").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


@query(
    "vectors_replaced",
    """SELECT CAST(vec_id AS VARCHAR) AS dataset_id, CASE WHEN label = 3 THEN 'new' ELSE 'given-64' END AS model,
              round(list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN label = 3 THEN -1 ELSE 1 END, 6) AS total
       FROM embeddings""",
)
def vectors_replaced(spark, folder):
    """All vectors of one label replaced by their opposites."""
    vectors = V.vectors(spark, folder)
    labels = V.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("dataset_id"), "label")
    staged = vectors.join(labels.filter("label = 3"), "dataset_id").select(
        "dataset_id", F.lit("new").alias("model"), F.transform("vector", lambda x: -x).alias("vector"), "updated_at"
    )
    ones = F.array_repeat(F.lit(1.0), DIMENSIONS)
    return D.replace_vectors(vectors, staged).select(
        "dataset_id", "model", F.round(VF.dot("vector", ones), 6).alias("total")
    )


_KINDS = "CAST(dataset_id AS BIGINT) % 50"
_WHOLE = f"({_KINDS} > 3)"


def _legacy(spark, folder):
    """Vectors as JSON text; some rows hold no vector: cut text, a word in it, an empty list, nothing."""
    kind = F.col("dataset_id").cast("bigint") % 50
    text = F.to_json("vector")
    broken = (
        F.when(kind == 0, F.substring(text, 1, 20)).when(kind == 1, F.lit('["a", 1.0]'))
        .when(kind == 2, F.lit("[]")).when(kind == 3, F.lit(None)).otherwise(text)
    )
    return V.vectors(spark, folder).select("dataset_id", "model", broken.alias("embedding"), "updated_at")


@query("vector_migration", f"""WITH {VECTORS}
SELECT dataset_id, CAST(len(vector) AS INTEGER) AS dimensions, round(list_sum(vector), 5) AS total FROM vectors
WHERE {_WHOLE}""")
def vector_migration(spark, folder):
    """Vectors held as JSON text moved into an empty vector table; what is no vector stays out."""
    vectors = V.vectors(spark, folder)
    moved = D.migrate_vectors(_legacy(spark, folder), vectors.filter(F.lit(False)))
    ones = F.array_repeat(F.lit(1.0), DIMENSIONS)
    return moved.select(
        "dataset_id", F.size("vector").alias("dimensions"), F.round(VF.dot("vector", ones), 5).alias("total")
    )


@query("vector_migration_rejects", f"WITH {VECTORS} SELECT dataset_id, 'given-64' AS model FROM vectors WHERE NOT {_WHOLE}")
def vector_migration_rejects(spark, folder):
    return D.legacy_rejects(_legacy(spark, folder))


@query("vector_migration_check", f"""WITH {VECTORS},
counts AS (SELECT count(*) AS legacy_count, count(*) FILTER (WHERE {_WHOLE}) AS new_count FROM vectors)
SELECT legacy_count, new_count, new_count >= legacy_count AS may_drop FROM counts""")
def vector_migration_check(spark, folder):
    legacy = _legacy(spark, folder)
    moved = D.migrate_vectors(legacy, V.vectors(spark, folder).filter(F.lit(False)))
    return D.migration_check(legacy, moved)


@query("dense_cells_batch", ORACLE["dense_topk_batch"])
def dense_cells_batch(spark, folder):
    """The rows of dense_topk_batch by cells: only those that can hold one of the best are read."""
    vectors, datasets, _ = _tables(spark, folder)
    return _rounded(PC.search_cells(PC.build_cells(vectors), centres(spark, folder), 10, datasets))


@query("dense_cells_filtered", ORACLE["dense_topk_batch_filtered"])
def dense_cells_filtered(spark, folder):
    vectors, datasets, _ = _tables(spark, folder)
    return _rounded(PC.search_cells(PC.build_cells(vectors), centres(spark, folder), 10, datasets, FILTERS))


@query("dense_cells_neighbours", _NEIGHBOURS)
def dense_cells_neighbours(spark, folder):
    """The five nearest vectors of every vector, by cells."""
    vectors = V.vectors(spark, folder)
    asked = vectors.select(F.col("dataset_id").alias("query_id"), "vector")
    return _rounded(PC.search_cells(PC.build_cells(vectors), asked, 5))
