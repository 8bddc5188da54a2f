"""Vector expressions, and the batch kernels that score blocks of vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(left: Column | str, right: Column | str) -> Column:
    """Dot product of two array columns in double precision, without Python."""
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalize(vector: Column | str) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def block(arrays: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix with one row per vector."""
    if isinstance(arrays, pa.ChunkedArray):
        arrays = arrays.combine_chunks()
    if len(arrays) == 0:
        return np.empty((0, 0))
    values = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if values.size % len(arrays):
        raise ValueError("vectors of unequal length")
    return values.reshape(len(arrays), -1)


def cosine_to(query: list[float]):
    """A vectorised scorer against one query of unit length: column in, score out; NULL stays NULL."""
    weights = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        given = np.asarray(vectors.is_valid())
        scores = np.zeros(len(vectors))
        if given.any():
            scores[given] = block(vectors.drop_null()) @ weights
        return pa.array(scores, mask=~given)

    return score


Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_of_block(scores: np.ndarray, ids: np.ndarray, k: int, carried: Best | None) -> Best:
    """Per row of scores the k best (score descending, id ascending), together with those carried over.

    Result: rows, scores and ids. A score of minus infinity is no hit.
    """
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    values, names = scores[rows, cols], ids[cols]
    if carried is not None:
        rows = np.concatenate([carried[0], rows])
        values = np.concatenate([carried[1], values])
        names = np.concatenate([carried[2], names])
    order = np.lexsort((names, -values, rows))
    rows, values, names = rows[order], values[order], names[order]
    starts = np.searchsorted(rows, rows, side="left")
    kept = np.arange(rows.size) - starts < k
    return rows[kept], values[kept], names[kept]


def hits_of(query_ids: np.ndarray, best: Best) -> pa.RecordBatch:
    """The best of a task as rows (query_id, dataset_id, score)."""
    rows, values, names = best
    return pa.RecordBatch.from_pydict(
        {
            "query_id": pa.array(query_ids[rows].tolist(), pa.string()),
            "dataset_id": pa.array(names.tolist(), pa.string()),
            "score": pa.array(values, pa.float64()),
        }
    )


HITS = "query_id string, dataset_id string, score double"


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_float32(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to an array of floats."""
    lists = [None if b is None else np.frombuffer(b, dtype="<f4") for b in blobs.to_pylist()]
    return pa.array(lists, type=pa.list_(pa.float32()))


def parse_vector(text: Column | str) -> Column:
    """A JSON array of numbers to an array of floats."""
    return F.from_json(text, "array<float>")
