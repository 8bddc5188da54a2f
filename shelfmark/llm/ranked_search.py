"""Ranked lexical search, term at a time with limited accumulators.

The index has one row per block of documents: its terms, and for each the documents that hold it with
their counts, as packed arrays. A block is made from about ``BLOCK_BYTES`` of whole texts by one task
and is small enough to be searched by one task; all terms of all documents are in it.

A query is worked on in each block from its rarest term to its commonest. Each term adds to the
accumulators of its documents. What the terms to come can add at most is known from the largest
share of each in the block. As soon as this is less than the k-th best partial score known, no document
without an accumulator can be among the first k: none is created any more, those that cannot
reach the score either are given up, and the others are updated with all remaining terms, so their
scores are exact. The k-th best partial score is the largest of three: that of a first round with
the rarest terms alone over all blocks, that of the blocks the task has done, and that of the block.

Scores are integers, so all bounds are exact; a bound that equals the score of rank k still lets
a document in, as it may win by its doc_id.

Defined results: a text without terms (null, empty) is in no count and no result; repeated documents
are ranked each on its own, equal scores by ascending doc_id with null last; each row of the items is an item,
also with an id that others have, and one without terms, or whose terms no document holds, gives no
row; further columns are not looked at; without documents or items there is no row.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.texts import give_back_memory, pieces, shared_path, split_words, text_array, written

# Texts of a block, and texts of the items that are searched for in one scan of the index.
BLOCK_BYTES = 16 << 20
ITEMS_BYTES = 2 << 20
# The first round takes the rarest terms of an item until they have this many entries for each rank.
SEED_ENTRIES = 4
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
# Bytes that end a term become spaces; bytes of other characters stay as they are.
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(_UPPER.encode(), _LOWER.encode()))
BLOCK_SCHEMA = "docs array<bigint>, lengths binary, terms binary, starts binary, posts binary, counts binary, n_docs bigint, n_terms bigint"


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest of 1, 2, 4 or 8 bytes each, behind a byte that says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and one space for each character outside terms."""
    texts = text_array(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(_BYTES) if data is not None and len(texts) else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(raw))


def index_block(docs: pa.Array, texts: pa.Array) -> dict:
    """The row of one block."""
    lengths, codes, terms = split_words(_spaced(texts))
    full = np.flatnonzero(lengths)
    n = max(1, len(full))
    row = np.repeat(np.arange(len(full)), lengths[full])
    entries, counts = np.unique(codes.astype(np.int64) * n + row, return_counts=True)
    starts = np.searchsorted(entries, np.arange(len(terms) + 1) * n)
    return {
        "docs": docs.take(pa.array(full)).to_pylist(),
        "lengths": pack(lengths[full]),
        "terms": "\n".join(terms.to_pylist()).encode(),
        "starts": pack(starts),
        "posts": pack(entries % n),
        "counts": pack(counts),
        "n_docs": len(full),
        "n_terms": int(lengths.sum()),
    }


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index of all texts as a table in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", BLOCK_BYTES):
            block = index_block(piece.column(0), piece.column(1))
            if block["n_docs"]:
                yield pa.RecordBatch.from_pylist([block], schema=_BLOCK)

    return written(docs.select(F.col(key).cast("bigint"), "text").mapInArrow(build, BLOCK_SCHEMA), "search-blocks")


_BLOCK = pa.schema([("docs", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("lengths", "terms", "starts", "posts", "counts")] + [("n_docs", pa.int64()), ("n_terms", pa.int64())])


def _places(terms: pa.Array, packed: bytes) -> np.ndarray:
    """The place of each of ``terms`` among those of a block, -1 where it is none of them."""
    there = pa.array(packed.decode().split("\n"))
    return pc.fill_null(pc.index_in(terms, value_set=there), -1).to_numpy(zero_copy_only=False)


def document_frequencies(index: DataFrame, terms: list[str]) -> list[int]:
    """The number of documents that hold each of the terms, which are those of one block of items."""
    wanted = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for packed, starts in zip(batch.column(0), batch.column(1), strict=True):
                at, start = _places(wanted, packed.as_py()), unpack(starts.as_py())
                here = at >= 0
                found[here] += start[at[here] + 1] - start[at[here]]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])

    counted = index.select("terms", "starts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = [0] * len(terms)
    for row in counted.collect():
        out[row["term"]] = row["n"]
    return out


class Item:
    """An item as its terms in order of rising frequency: their places among all terms, and their weights times repeats."""

    def __init__(self, counted: Counter, number: dict[str, int], df: list[int], n: int):
        there = sorted((df[number[t]], t) for t in counted if df[number[t]])
        self.terms = np.array([number[t] for _, t in there], np.int64)
        weights = [counted[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d, t in there]
        self.weights = np.array(weights, np.int64)
        self.entries = np.cumsum([d for d, _ in there])

    def rarest(self, entries: int) -> "Item":
        """The item with its rarest terms only, that have so many entries together."""
        out = object.__new__(Item)
        stop = int(np.searchsorted(self.entries, entries)) + 1
        out.terms, out.weights, out.entries = self.terms[:stop], self.weights[:stop], self.entries[:stop]
        return out


class Block:
    """One row of the index, with what each term adds to its documents at weight 1."""

    def __init__(self, row: dict, terms: pa.Array, n: int, length: int):
        self.docs = row["docs"]
        self.at = _places(terms, row["terms"])
        self.starts, self.posts, self.counts = unpack(row["starts"]), unpack(row["posts"]), unpack(row["counts"])
        self.slow = 12 * (75 + (25 * unpack(row["lengths"]) * n) // length)
        self.known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def shares(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(documents, shares, largest share) of a term; None if the block has it not."""
        if self.at[term] < 0:
            return None
        if term not in self.known:
            begin, end = self.starts[self.at[term]], self.starts[self.at[term] + 1]
            posts, tf = self.posts[begin:end], self.counts[begin:end]
            shares = (1_000_000_000 * tf) // (1000 * tf + self.slow[posts])
            self.known[term] = posts, shares, int(shares.max())
        return self.known[term]


def rank_block(block: Block, item: Item, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents of a block that may be among the first k: all that reach
    ``least``, a score that k documents are known to have, and are not beaten by k of this block."""
    lists = [(s, w) for s, w in ((block.shares(int(t)), w) for t, w in zip(item.terms, item.weights, strict=True)) if s is not None]
    remaining = np.concatenate((np.cumsum([s[2] * int(w) for s, w in lists][::-1])[::-1], [0])).astype(np.int64)
    scores = np.zeros(len(block.docs), np.int64)
    alive, best = None, 0
    for j, ((posts, shares, _), weight) in enumerate(lists):
        if alive is None and remaining[j] < least:
            alive = (scores > 0) & (scores + remaining[j] >= least)
        if alive is not None:
            kept = alive[posts]
            scores[posts[kept]] += shares[kept] * weight
            continue
        scores[posts] += shares * weight
        best = max(best, int(scores[posts].max()))
        if remaining[j + 1] < best and len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    found = np.flatnonzero(((scores > 0) if alive is None else alive) & (scores >= max(1, least)))
    return found, scores[found]


def first_of(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then lowest doc_id; null (as a masked value) last."""
    order = np.lexsort((docs.filled(0), np.ma.getmaskarray(docs), -scores))
    return order[:k]


def _ranked(index: DataFrame, items: list[Item], least: list[int], terms: list[str], n: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): what may be among the first k of each item, at most k per task."""
    # Bounded: the terms of one block of items.
    sent = index.sparkSession.sparkContext.broadcast((items, least, terms))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, names = sent.value[0], list(sent.value[1]), pa.array(sent.value[2], pa.string())
        best: list[tuple[np.ma.MaskedArray, np.ndarray] | None] = [None] * len(wanted)
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], names, n, length)
                ids = np.ma.array([0 if d is None else d for d in block.docs], mask=[d is None for d in block.docs], dtype=np.int64)
                for i, item in enumerate(wanted):
                    found, scores = rank_block(block, item, k, known[i])
                    if not len(found):
                        continue
                    docs = ids[found]
                    if best[i] is not None:
                        docs, scores = np.ma.concatenate((best[i][0], docs)), np.concatenate((best[i][1], scores))
                    first = first_of(docs, scores, k)
                    best[i] = docs[first], scores[first]
                    if len(first) == k:
                        known[i] = max(known[i], int(scores[first[-1]]))
        for i, hits in enumerate(best):
            if hits is not None:
                item = pa.array(np.full(len(hits[1]), i, np.int32))
                docs = pa.array(hits[0].filled(0), pa.int64(), mask=np.ma.getmaskarray(hits[0]))
                yield pa.RecordBatch.from_arrays([item, docs, pa.array(hits[1], pa.int64())], ["item", "doc_id", "score"])
        give_back_memory()

    return index.mapInArrow(rank, "item int, doc_id bigint, score bigint")


def _in_order(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks_of_items(items: DataFrame, item_id: str) -> Iterator[list[tuple]]:
    """Lists of (id, text) of at most ITEMS_BYTES, or one item."""
    block, size = [], 0
    for row in items.select(item_id, F.coalesce("text", F.lit(""))).toLocalIterator():
        if block and size + len(row[1]) > ITEMS_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def search_index(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by blocks of items."""
    spark: SparkSession = index.sparkSession
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n, length = int(totals[0]), int(totals[1])
    path = shared_path(spark, "search-hits")
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks_of_items(items, item_id) if n else ():
        counted = [Counter(TERM.findall(text.translate(_TO_LOWER))) for _, text in block]
        terms = sorted(set().union(*counted))
        number = {t: i for i, t in enumerate(terms)}
        df = document_frequencies(index, terms)
        wanted = [Item(c, number, df, n) for c in counted]
        # The first round: k documents are known to reach these scores.
        seeds = _in_order(_ranked(index, [w.rarest(SEED_ENTRIES * k) for w in wanted], [0] * len(wanted), terms, n, length, k), k)
        least = [0] * len(wanted)
        for row in seeds.filter(F.col("rank") == k).select("item", "score").collect():
            least[row["item"]] = row["score"]
        hits = _in_order(_ranked(index, wanted, least, terms, n, length, k), k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, item_id {kind}")
        hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    return search_index(build_index(docs), items, k)


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_CLASS}')) AS term FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
slow AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM sizes, totals),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_CLASS}')) AS term FROM benchmark
),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN slow USING (doc_id) GROUP BY ALL
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""
