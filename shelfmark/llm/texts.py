"""Helpers for work on Arrow batches of texts inside tasks, and tables in the shared folder."""

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfmark.session import checkpoint_folder

# Texts are worked on in pieces of about this many bytes; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def shared_path(spark, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Return what a worker no longer uses: it stays alive between tasks, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece stay near the limit; memory goes back at the end."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back_memory()


def text_array(column: pa.Array) -> pa.Array:
    """The texts of a column, null as empty."""
    return pc.fill_null(column, "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words per text, the words of all texts as codes, and the distinct words."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(full)))
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    counts = ends[offsets[1:]] - ends[offsets[:-1]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser over whole arrays."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def hash_strings(words: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash per string."""
    if not len(words):
        return np.empty(0, np.uint64)
    return mix(pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) + _MIX)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each text as sorted 64-bit hashes: (offsets per text, hashes).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    ``width`` has its whole sequence as one shingle, a text without words has none.
    """
    counts, codes, distinct = split_words(pc.ascii_lower(texts))
    words = hash_strings(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _SHINGLE + words[k : k + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for row, count in enumerate(counts):
        begin = starts[row]
        if count >= width:
            values = np.sort(rolled[begin : begin + count - width + 1])
            if len(values) > 1:
                values = values[np.concatenate(([True], values[1:] != values[:-1]))]
        elif count:
            value = np.uint64(count)
            for word in words[begin : begin + count]:
                value = np.uint64((int(value) * int(_SHINGLE) + int(word)) & 0xFFFFFFFFFFFFFFFF)
            values = mix(np.array([value]))
        else:
            values = np.empty(0, np.uint64)
        sets.append(values)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return offsets, np.concatenate(sets) if sets else np.empty(0, np.uint64)
