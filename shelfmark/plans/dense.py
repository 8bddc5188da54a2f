"""Dense search over stored vectors, and the job that fills them."""

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import constants as C
from shelfmark.functions import text as X
from shelfmark.functions import vectors as V
from shelfmark.functions.times import moment
from shelfmark.operators.catalog import Filters
from shelfmark.operators.keyed import require_unique, upsert
from shelfmark.operators.ranking import top_k
from shelfmark.plans.search import best_first, hit_page, restrict

# Queries up to this number go to every task as one matrix; more are cut into a grid.
BROADCAST_QUERIES = 2048
GRID_QUERIES = 2048
GRID_VECTORS = 100_000
# Scores held at a time by one task.
BLOCK_SCORES = 4_000_000
# Scores are ranked as they are, but for the last bits, which tell the order of summation; ties go by id.
SCORE_DECIMALS = 12


def score_vectors(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(dataset_id, score): cosine of every stored unit vector with one unit query vector.

    Rows without a vector have no score.
    """
    scored = vectors.select("dataset_id", F.round(V.cosine_to(query)("vector"), SCORE_DECIMALS).alias("score"))
    return scored.filter("score is not null")


def search_dense(
    vectors: DataFrame,
    datasets: DataFrame,
    artifacts: DataFrame,
    query: list[float],
    filters: Filters | None = None,
    limit: int = C.SEARCH_LIMIT_DEFAULT,
    offset: int = 0,
    sample_rows: DataFrame | None = None,
) -> DataFrame:
    """One page of datasets nearest to the query vector.

    Vectors are scored where they lie; only (dataset_id, score) is joined with the
    filtered catalog.
    """
    scored = restrict(score_vectors(vectors, query), datasets, filters)
    return hit_page(scored, datasets, artifacts, [], limit, offset, sample_rows)


def dense_total(vectors: DataFrame, datasets: DataFrame, filters: Filters | None = None) -> DataFrame:
    return restrict(vectors.select("dataset_id"), datasets, filters).agg(F.count("*").alias("total"))


def _best_of_batch(
    queries: np.ndarray, batch: pa.RecordBatch, k: int, best: V.Best | None
) -> V.Best | None:
    """Score a batch piece by piece, so that a task holds few scores at a time; rows without a vector are passed over."""
    batch = batch.filter(batch.column("vector").is_valid())
    step = max(1, BLOCK_SCORES // len(queries))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        ids = np.asarray(part.column("dataset_id").to_pylist(), dtype=str)
        scores = np.round(queries @ V.block(part.column("vector")).T, SCORE_DECIMALS)
        best = V.best_of_block(scores, ids, k, best)
    return best


def _scan_best(vectors: DataFrame, query_ids: list[str], matrix: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((np.asarray(query_ids, dtype=str), matrix))

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        best = None
        for batch in batches:
            best = _best_of_batch(queries, batch, k, best)
        if best is not None:
            yield V.hits_of(names, best)

    return vectors.mapInArrow(best_of_partition, V.HITS)


def _grid_best(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cut vectors and queries into bounded parts; one task scores one part against one other."""
    cuts = max(1, -(-vectors.count() // GRID_VECTORS))
    blocks = max(1, -(-queries.count() // GRID_QUERIES))
    left = vectors.withColumn("cut", F.pmod(F.xxhash64("dataset_id"), F.lit(cuts))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cuts - 1).cast("bigint")))
    )

    def best_of_cell(stored: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table(
            {"query_id": pa.array([], pa.string()), "dataset_id": pa.array([], pa.string()),
             "score": pa.array([], pa.float64())}
        )
        if not stored.num_rows or not asked.num_rows:
            return empty
        names = np.asarray(asked.column("query_id").to_pylist(), dtype=str)
        matrix = V.block(asked.column("vector"))
        best = None
        for batch in stored.combine_chunks().to_batches():
            best = _best_of_batch(matrix, batch, k, best)
        return pa.Table.from_batches([V.hits_of(names, best)])

    return (
        left.groupBy("cut", "block")
        .cogroup(right.groupBy("cut", "block"))
        .applyInArrow(best_of_cell, V.HITS)
    )


def search_dense_batch(
    vectors: DataFrame,
    datasets: DataFrame | None,
    queries: DataFrame,
    k: int,
    filters: Filters | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """(query_id, rank, dataset_id, score): the k nearest datasets of every query (query_id, vector).

    Exact. Each task multiplies its vectors with the queries and passes on the k best
    per query only. ``datasets`` restricts to existing and filtered rows.
    """
    stored = vectors.select("dataset_id", "vector")
    if datasets is not None:
        stored = restrict(stored, datasets, filters)
    asked = queries.select("query_id", "vector")
    some = asked.limit(broadcast_queries + 1).toArrow()
    if some.num_rows == 0:
        best = asked.select("query_id", F.lit("").alias("dataset_id"), F.lit(0.0).alias("score"))
    elif some.num_rows <= broadcast_queries:
        best = _scan_best(stored, some.column("query_id").to_pylist(), V.block(some.column("vector")), k)
    else:
        best = _grid_best(stored, asked, k)
    return top_k(best, ["query_id"], best_first(), k).select("query_id", "rank", "dataset_id", "score")


class HashingEmbedder:
    """Offline embedder: tokens hashed to signed dimensions, counted, scaled to unit length."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions
        self.name = f"token-hash-{dimensions}"

    def load(self) -> Callable[[list[str]], np.ndarray]:
        dimensions = self.dimensions

        @lru_cache(maxsize=1 << 20)
        def place(token: str) -> tuple[int, float]:
            code = int(md5(token.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16)
            return (code >> 1) % dimensions, 1.0 if code & 1 else -1.0

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for row, text in zip(out, texts):
                for token in (text or "").lower().split():
                    index, sign = place(token)
                    row[index] += sign
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms > 0, norms, 1.0)

        return embed


def embedding_column(embedder, text: Column | str) -> Column:
    """Texts to unit vectors in Arrow batches; the model is loaded once per Python worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = embedder.load()
        for texts in batches:
            yield pd.Series(list(run(texts.tolist()).astype(np.float32)), index=texts.index, dtype=object)

    return embed(text)


def embedding_inputs(datasets: DataFrame) -> DataFrame:
    """(dataset_id, text) of every catalog row."""
    return datasets.select(F.col("id").alias("dataset_id"), X.catalog_text().alias("text"))


def pending_inputs(
    datasets: DataFrame, vectors: DataFrame, limit: int | None = None, force: bool = False
) -> DataFrame:
    """Inputs still to embed: all with ``force``, else those without a vector."""
    # Ids are chosen first; texts are put together for the chosen rows only.
    ids = datasets.select("id")
    if not force:
        ids = ids.join(vectors.select(F.col("dataset_id").alias("id")), "id", "left_anti")
    if limit:
        ids = ids.orderBy("id").limit(limit)
    return embedding_inputs(datasets if force and not limit else datasets.join(ids, "id", "left_semi"))


def embed_catalog(
    datasets: DataFrame,
    vectors: DataFrame,
    embedder=None,
    limit: int | None = None,
    force: bool = False,
    as_of: Column | datetime | str | None = None,
) -> DataFrame:
    """New rows of the vector table for the datasets still to embed."""
    embedder = embedder or HashingEmbedder(384)
    return pending_inputs(datasets, vectors, limit, force).select(
        "dataset_id",
        F.lit(embedder.name).alias("model"),
        embedding_column(embedder, "text").alias("vector"),
        moment(as_of).alias("updated_at"),
    )


def replace_vectors(vectors: DataFrame, staged: DataFrame) -> DataFrame:
    """The vector table with the staged rows put in; a staged id may occur only once."""
    return upsert(vectors, require_unique(staged.select(*vectors.columns), ["dataset_id"]), ["dataset_id"])


def embedding_status(vectors: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: embedded_count, total_datasets, model."""
    have = vectors.agg(F.count("*").alias("embedded_count"), F.min("model").alias("model"))
    total = datasets.agg(F.count("*").alias("n")).scalar()
    return have.select("embedded_count", total.alias("total_datasets"), "model")


def vector_signature(vectors: DataFrame) -> DataFrame:
    """One row that changes with the vector table: row count and latest update."""
    return vectors.agg(F.count("*").alias("vectors"), F.max("updated_at").alias("last_update"))


def _converted(legacy: DataFrame) -> DataFrame:
    is_text = "embedding" in legacy.columns
    vector = V.parse_vector("embedding") if is_text else V.decode_float32("vector")
    whole = F.when((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), vector)
    return legacy.select("dataset_id", "model", whole.alias("vector"), "updated_at")


def convert_legacy_vectors(legacy: DataFrame) -> DataFrame:
    """Vectors held as JSON text (column embedding) or as float32 bytes (column vector) to arrays.

    Rows that hold no vector are left out; ``legacy_rejects`` names them.
    """
    return _converted(legacy).filter("vector is not null")


def legacy_rejects(legacy: DataFrame) -> DataFrame:
    """(dataset_id, model) of legacy rows whose text or bytes are no vector."""
    return _converted(legacy).filter("vector is null").select("dataset_id", "model")


def migrate_vectors(legacy: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector table with all legacy rows converted and put in."""
    return replace_vectors(vectors, convert_legacy_vectors(legacy))


def migration_check(legacy: DataFrame, migrated: DataFrame) -> DataFrame:
    """One row: legacy and new row counts, and whether the legacy table may be dropped."""
    new = migrated.filter(F.col("vector").isNotNull()).agg(F.count("*").alias("n")).scalar()
    return legacy.agg(F.count("*").alias("legacy_count")).select(
        "legacy_count", new.alias("new_count"), (new >= F.col("legacy_count")).alias("may_drop")
    )
