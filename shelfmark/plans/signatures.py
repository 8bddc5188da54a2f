"""Substring search behind character trigram signatures.

Texts keep the order they come in and lie in blocks of ``1 << BLOCK_BITS`` texts. A trigram of
characters is hashed to one of 65,536 slots. For each slot and segment of 64 blocks there is a word
of 64 bits: the blocks that hold such a trigram. A search reads the words of its tokens' trigrams
only; the words of a token are joined by AND, those of the tokens by OR, and the bits that are left
are the blocks that may hold a token. Only those are read, by ranges that reach the Parquet scan,
and ``contains`` decides there: a signature shuts out no hit, it can only let a block through in vain.

Tokens of fewer than three characters have no trigram: a query with one reads all blocks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.operators.catalog import Filters
from shelfmark.plans.search import hit_page, matches, query_tokens, restrict
from shelfmark.session import materialised, shared_path

SLOT_BITS = 16
BLOCK_BITS = 6
SEGMENT_BITS = 6
# Ranges of blocks that one scan is given at most; neighbouring blocks are taken together beyond it.
MOST_RANGES = 1000
# Bits of a block number that are cut for that, from single blocks up to whole parts of the table.
RANGE_SHIFTS = (0, 3, 6, 10, 14, 33 - BLOCK_BITS)
# Characters of a text that are hashed at a time.
PIECE = 1 << 20
WORDS = "slot int, segment bigint, word bigint"


@dataclass(frozen=True)
class Signatures:
    """texts (dataset_id, content, block); words (slot, segment, word)."""

    texts: DataFrame
    words: DataFrame


def slots(text: str) -> np.ndarray:
    """The slots of all trigrams of a text, with repeats."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if codes.size < 3:
        return np.empty(0, dtype=np.int64)
    mixed = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, content) in order of blocks to the words of their segments; one segment is held at a time."""
    segment, words = None, np.zeros(1 << SLOT_BITS, dtype=np.uint64)

    def flush() -> pa.RecordBatch:
        held = np.flatnonzero(words)
        columns = [pa.array(held, pa.int32()), pa.array(np.full(held.size, segment), pa.int64()), pa.array(words[held].view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["slot", "segment", "word"])

    for batch in batches:
        for block, content in zip(batch.column("block").to_pylist(), batch.column("content")):
            now = block >> SEGMENT_BITS
            if now != segment:
                if segment is not None:
                    yield flush()
                segment = now
                words[:] = 0
            text = content.as_py() or ""
            bit = np.uint64(1 << (block & ((1 << SEGMENT_BITS) - 1)))
            for start in range(0, max(len(text) - 2, 0), PIECE):
                words[slots(text[start : start + PIECE + 2])] |= bit
    if segment is not None:
        yield flush()


def build_signatures(corpus: DataFrame, folder: str | None = None, block_bits: int = BLOCK_BITS) -> Signatures:
    """The index of a corpus (dataset_id, content), kept in ``folder`` or a new one in the shared folder.

    Texts are written once, where they lie; only words are shuffled: at most 65,536 per segment.
    """
    spark = corpus.sparkSession
    folder = folder or shared_path(spark, "signatures")
    block = F.shiftright(F.monotonically_increasing_id(), block_bits)
    corpus.select("dataset_id", "content", block.alias("block")).write.parquet(f"{folder}/texts")
    texts = spark.read.schema("dataset_id string, content string, block bigint").parquet(f"{folder}/texts")
    # A segment may lie in several tasks of this scan, each with some of its texts.
    words = texts.select("block", "content").mapInArrow(_words_of, WORDS)
    words = words.groupBy("slot", "segment").agg(F.bit_or("word").alias("word"))
    words.repartitionByRange("slot", "segment").sortWithinPartitions("slot", "segment").write.parquet(f"{folder}/words")
    return load_signatures(spark, folder)


def load_signatures(spark: SparkSession, folder: str) -> Signatures:
    """An index that build_signatures has left in a folder."""
    return Signatures(
        spark.read.schema("dataset_id string, content string, block bigint").parquet(f"{folder}/texts"),
        spark.read.schema(WORDS).parquet(f"{folder}/words"),
    )


def fitting_blocks(index: Signatures, query: str) -> DataFrame | None:
    """(block) of all blocks that may hold a token of the query; None if that may be any block."""
    tokens = list(dict.fromkeys(query_tokens(query)))
    if any(len(token) < 3 for token in tokens):
        return None
    asked = [(number, int(slot)) for number, token in enumerate(tokens) for slot in np.unique(slots(token))]
    spark = index.words.sparkSession
    # One row per trigram of the query.
    wanted = spark.createDataFrame(asked, "token int, slot int")
    needed = F.col("needed")
    sizes = wanted.groupBy("token").agg(F.count("*").alias("needed"))
    read = index.words.filter(F.col("slot").isin(sorted({slot for _, slot in asked})))
    each = read.join(F.broadcast(wanted), "slot").groupBy("token", "segment").agg(F.bit_and("word").alias("word"), F.count("*").alias("n"))
    each = each.join(F.broadcast(sizes), "token").filter((F.col("n") == needed) & (F.col("word") != 0))
    fits = each.groupBy("segment").agg(F.bit_or("word").alias("word"))
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << SEGMENT_BITS) - 1)), lambda i: F.getbit("word", i) == 1)
    return fits.select(F.explode(F.transform(places, lambda i: F.shiftleft("segment", SEGMENT_BITS) + i)).alias("block"))


def _ranges(blocks: DataFrame) -> list[tuple[int, int]] | None:
    """At most MOST_RANGES ranges that cover the blocks; None if they lie in more parts of the table than that."""
    blocks = materialised(blocks, "fitting-blocks")
    for shift in RANGE_SHIFTS:
        spans = blocks.groupBy(F.shiftright("block", shift).alias("span")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
        found = spans.select("low", "high").limit(MOST_RANGES + 1).collect()
        if len(found) <= MOST_RANGES:
            return sorted((row["low"], row["high"]) for row in found)
    return None


def fitting_texts(index: Signatures, query: str) -> DataFrame:
    """(dataset_id, content) of the blocks that may hold a token of the query."""
    texts = index.texts
    blocks = fitting_blocks(index, query)
    ranges = _ranges(blocks) if blocks is not None else None
    if ranges is not None:
        conditions = [F.col("block").between(low, high) for low, high in ranges] or [F.lit(False)]
        # Pairs of pairs, so that many ranges make no deep expression.
        while len(conditions) > 1:
            conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) & ~1 :]
        texts = texts.filter(conditions[0])
    return texts.select("dataset_id", "content")


def signed_matches(index: Signatures, query: str) -> DataFrame:
    """(dataset_id, score) of every text that holds at least one token of the query: the rows of ``search.matches``."""
    return matches(fitting_texts(index, query), query)


def search_signed(
    index: Signatures,
    datasets: DataFrame,
    artifacts: DataFrame,
    query: str,
    filters: Filters | None = None,
    limit: int = C.SEARCH_LIMIT_DEFAULT,
    offset: int = 0,
) -> DataFrame:
    """One page of datasets whose text holds any token of the query: the rows of ``search.search_tokens``."""
    scored = restrict(signed_matches(index, query), datasets, filters)
    return hit_page(scored, datasets, artifacts, query_tokens(query), limit, offset)


def blocks_read(index: Signatures, query: str) -> DataFrame:
    """One row: all blocks, and those that a query reads."""
    blocks = index.texts.select("block").distinct()
    fitting = fitting_blocks(index, query)
    read = blocks if fitting is None else fitting
    return blocks.agg(F.count("*").alias("blocks")).select("blocks", read.agg(F.count("*").alias("n")).scalar().alias("blocks_read"))
