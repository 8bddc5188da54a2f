"""Benchmark decontamination by q-gram counting in diagonal bands, verified by banded alignment.

A passage with at most k edits of an item of m characters keeps ``m - q + 1 - k * q`` of its
q-grams, on diagonals that lie within k of each other. Each text is scanned once for the
q-grams of all items; hits are counted per item and band of diagonals (bands overlap by
half, so one of them holds the whole passage), and only regions that meet the bound are aligned.
Grams and edits are of characters. For counting, characters beyond Latin-1 are folded into one byte,
which can only add shared grams; the alignment compares the characters themselves.
Benchmarks are sent to the tasks in blocks of a bounded size; each block is one scan.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import pieces, text_array, written

Q = 12
# For items so short that q-grams of Q leave no bound at their number of edits.
SHORT_Q = 8
EDITS = 0.05
# Shared grams of a text that are counted at a time.
HITS_AT_ONCE = 2_000_000
# Bytes of item texts in one broadcast index (its arrays take about 32 times as much).
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 20
_FOUND = "doc_id bigint, item_id bigint, begin bigint, length int, edits int"


def normalise(texts: pa.Array) -> list[str]:
    """Lower case, white space runs as one space."""
    return [b" ".join(t.as_buffer().to_pybytes().split()).decode(errors="replace") for t in pc.utf8_lower(text_array(texts))]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> bytes:
    """One byte per character: itself up to Latin-1, else one of the upper half."""
    if text.isascii():
        return text.encode()
    codes = points(text)
    return np.where(codes < 256, codes, 128 + codes % 128).astype(np.uint8).tobytes()


def gram_size(size: int, edits: int, q: int) -> int | None:
    """The longest q-gram, of q and SHORT_Q, of which one must be kept; None if there is none."""
    return next((n for n in (q, min(q, SHORT_Q)) if size - n + 1 - edits * n >= 1), None)


def grams(text: bytes, q: int = Q) -> np.ndarray:
    """A 64-bit code per position, of the q bytes from there (q from 8 to 16)."""
    count = len(text) - q + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    codes = eight[:count] * np.uint64(0x9E3779B97F4A7C15)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes + eight[q - 8 : q - 8 + count] * np.uint64(0x94D049BB133111EB)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """The fewest edits between the item and a stretch of the text, with text position minus
    item position kept in low..high. Returns (edits, begin, end)."""
    x, y = item, text
    diagonals = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    cost = np.where((diagonals >= 0) & (diagonals <= len(y)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(len(diagonals))
    for row in range(1, len(x) + 1):
        at = row + diagonals - 1  # the text character that this row's cell ends on
        inside = (at >= 0) & (at < len(y))
        same = np.zeros(len(at), bool)
        same[inside] = y[at[inside]] == x[row - 1]
        best, source = np.where(inside, cost + ~same, far), begin.copy()
        skip = np.append(cost[1:] + 1, far)  # an item character that the text lacks
        better = skip < best
        best[better], source[better] = skip[better], np.append(begin[1:], 0)[better]
        shifted = best - steps  # text characters that the item lacks run along the row
        leader = np.maximum.accumulate(np.where(shifted == np.minimum.accumulate(shifted), steps, 0))
        cost = np.where((at >= -1) & (at < len(y)), best[leader] + steps - leader, far)
        begin = source[leader]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), int(len(x) + diagonals[end])


class Index:
    """The q-grams of some items, sorted by code."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, edits: float = EDITS):
        self.q, self.ids, self.plain = q, ids, texts
        self.texts, self.points = [folded(t) for t in texts], [points(t) for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.budget = np.floor(sizes * edits).astype(np.int64)
        self.need = sizes - q + 1 - self.budget * q
        codes = [grams(t, q) for t in self.texts]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.repeat(np.arange(len(texts)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else np.empty(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.code >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        # Items of fewer than q characters are found as whole texts only; those of which all grams may be lost are always aligned.
        self.short: dict[str, list[int]] = {}
        for i, t in zip(ids, texts):
            if len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.always = np.flatnonzero((sizes >= q) & (self.need < 1)).tolist()

    def hits(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text position, entry) of every shared q-gram, some at a time."""
        codes = grams(text, self.q)
        at = np.flatnonzero(self.table[(codes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        first = np.searchsorted(self.code, codes[at], "left")
        count = np.searchsorted(self.code, codes[at], "right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        upto = np.cumsum(count)
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + HITS_AT_ONCE, "right")))
            some = count[start:stop]
            entry = np.repeat(first[start:stop], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(at[start:stop], some), entry
            start = stop

    def regions(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of bands that meet the bound; neighbours joined."""
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, entry in self.hits(text):
            item = self.item[entry]
            half = (at - self.place[entry]) // (self.budget[item] + 1)
            # Counts per item and half band add up over the pieces.
            found, n = np.unique((item << 40) + half + (1 << 39), return_counts=True)
            keys, back = np.unique(np.concatenate((keys, found)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        item, half = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)
        follows = np.concatenate(((item[1:] == item[:-1]) & (half[1:] == half[:-1] + 1), [False]))[: len(item)]
        both = counts + np.where(follows, np.append(counts[1:], 0), 0)
        found = [(i, -int(self.budget[i]), len(text)) for i in self.always]
        for k in np.flatnonzero((both >= self.need[item]) & (self.need[item] >= 1)).tolist():
            width = int(self.budget[item[k]]) + 1
            low, high = int(half[k]) * width, (int(half[k]) + 2) * width - 1
            if found and found[-1][0] == item[k] and found[-1][2] >= low - 1:
                found[-1] = (found[-1][0], found[-1][1], high)
            else:
                found.append((int(item[k]), low, high))
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, begin, length, edits) of the passages within the edit budget, one per region."""
        rows = [(i, 0, len(text), 0) for i in self.short.get(text, ())]
        raw, codes = folded(text), None
        for item, low, high in self.regions(raw):
            own, budget = self.texts[item], int(self.budget[item])
            exact = raw.find(own, max(0, low), max(0, high) + len(own))
            if exact >= 0 and text[exact : exact + len(own)] == self.plain[item]:
                rows.append((self.ids[item], exact, len(own), 0))
                continue
            codes = points(text) if codes is None else codes
            start = max(0, low - budget)
            part = codes[start : high + len(own) + budget + 1]
            edits, begin, end = align(self.points[item], part, low - budget - start, high + budget - start)
            if edits <= budget:
                rows.append((self.ids[item], start + begin, end - begin, edits))
        return rows


def _indexes(benchmark: DataFrame, q: int, edits: float, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark as broadcast indexes of bounded size, one after the other."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(items.filter("length(text) > 0"), "benchmark")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        kept = [(i, t) for i, t in zip(part["item_id"].to_pylist(), normalise(part["text"].combine_chunks())) if t]
        by_size: dict[int, list[tuple[int, str]]] = {}
        for i, t in kept:
            by_size.setdefault((gram_size(len(t), int(len(t) * edits), q) or q) if len(t) >= q else q, []).append((i, t))
        for size, some in sorted(by_size.items()):
            yield items.sparkSession.sparkContext.broadcast(Index(*map(list, zip(*some)), size, edits))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per passage of a benchmark item in a document: doc_id, item_id, begin and
    length (characters of the normalised text) and edits, at most ``edits`` of the item's characters.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read.
    Null or empty texts and items match nothing. Items of fewer than q characters match a text
    that equals them. Repeated items and documents give rows each, null ids are ids. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for index in _indexes(benchmark, q, edits, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                rows = []
                for doc, text in zip(piece.column("doc_id").to_pylist(), normalise(piece.column("text"))):
                    rows += [(doc, *match) for match in index.value.matches(text)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    names = ["doc_id", "item_id", "begin", "length", "edits"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        found = found.unionByName(docs.mapInArrow(scan, _FOUND))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any passage of the benchmark, with their own columns; judged where they lie."""
    for index in _indexes(benchmark, q, edits, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                yield piece.filter(pa.array([not index.value.matches(text) for text in normalise(piece.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
