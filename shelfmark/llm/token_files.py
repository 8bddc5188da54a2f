"""Token ids in bit-packed blocks: every id takes the minimum number of bits of the vocabulary.

A token file set is a folder of Parquet shards. A row is one block: whole documents in
ascending doc_id order, their id counts, and the packed ids as bytes, least bit first.
``shard`` and ``block`` order the blocks, ``first_doc`` and ``last_doc`` find a document
(Parquet statistics skip the other blocks), the counts give the offset of a document in
its block. A block closes at ``block_ids`` ids, so a longer document is a block of its own.
"""

import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.texts import pieces, shared_path, split_words, text_array

BLOCK_IDS = 1 << 18
# Words kept by one worker; beyond that its memory of words is emptied.
CACHED_WORDS = 500_000
# Texts are encoded in pieces of about so many bytes: the arrays made of a piece take some 30 times as much.
ENCODE_BYTES = 1 << 20
NULL_ID = -(1 << 63)
BLOCK_SCHEMA = (
    "shard int, block int, first_doc bigint, last_doc bigint, n_docs int, n_ids bigint, bits int, "
    "doc_ids binary, doc_lengths binary, payload binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each (1 to 32), back to back."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    lanes = np.zeros((groups, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 8), np.uint8)  # 8 ids fill exactly ``bits`` bytes
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        shifted = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start`` on; reads only the bytes that hold them."""
    if not count:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f"<u{width}", count, start * width).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload[first : ((start + count) * bits + 7) // 8] + bytes(8), np.uint8)
    at = np.arange(start, start + count, dtype=np.int64) * bits - first * 8
    windows = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # 8 bytes from each byte on
    return (windows[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


# A letter and the ASCII mark behind it, apostrophe left out: the pre-tokenizer always cuts between them.
# Not so behind a capital I with a dot, which lower-cases to two characters: such words are encoded with their marks.
_CUT = r"([^\PLİ])([!-&(-/:-@\[-`{-~])"
# How a special token may begin in a text.
_SPECIAL = "<|"


class WordEncoder:
    """A tokenizer of words, with each distinct word encoded once per worker.

    Valid for tokenizers that lower-case, whose pre-tokenizer never joins text over white
    space and cuts runs of letters from punctuation, as word_bpe_49k does: a text's ids are
    then those of its words, one after the other. Texts that may hold special tokens
    are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.word_end[number] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)  # where the ids of each word end in the pool
        self.pool = np.empty(0, np.uint32)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), [len(f) for f in found]

    def learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        pools, lengths = [self.pool], []
        for at in range(0, len(letters), 1024):
            some = letters[at : at + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            # A word of letters is one pre-token, so its last id is a word end; else they go one by one.
            sizes = np.diff(ends, prepend=0) if len(ends) == len(some) else None
            if sizes is None:
                ids, sizes = self._one_by_one(some)
            pools.append(ids)
            lengths.append(sizes)
        if others:
            ids, sizes = self._one_by_one(others)
            pools.append(ids)
            lengths.append(sizes)
        self.index.update(zip(letters + others, range(len(self.index), len(self.index) + len(words))))
        self.pool = np.concatenate(pools)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per text, ids of all texts)."""
        special = pc.match_substring(texts, _SPECIAL)
        if pc.any(special).as_py():
            return self._encode_some_whole(texts, special.to_numpy(zero_copy_only=False))
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), _CUT, r"\1 \2")
        counts, codes, distinct = split_words(cut)
        words = distinct.to_pylist()
        if len(self.index) + len(words) > CACHED_WORDS:
            self.forget()
        new = [w for w in words if w not in self.index]
        if new:
            self.learn(new)
        if not len(codes):
            return counts, np.empty(0, np.uint32)
        places = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[codes]
        starts, lengths = self.ends[places], self.ends[places + 1] - self.ends[places]
        upto = np.cumsum(lengths)
        at = np.repeat(starts - (upto - lengths), lengths)
        at += np.arange(len(at))
        return np.diff(np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))]), self.pool[at]

    def _encode_some_whole(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, parts = [], []
        plain = self.encode(texts.filter(pa.array(~special)))
        plain_parts = iter(np.split(plain[1], np.cumsum(plain[0])[:-1]) if len(plain[0]) else [])
        for row, whole in enumerate(special):
            if whole:
                ids = self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids
                part = np.array(ids, np.uint32)
            else:
                part = next(plain_parts)
            parts.append(part)
            counts.append(len(part))
        return np.array(counts, np.int64), np.concatenate(parts)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _block(shard: int, number: int, doc_ids: list, lengths: list, ids: list, bits: int) -> dict:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    return {
        "shard": shard, "block": number, "first_doc": doc_ids[0], "last_doc": doc_ids[-1], "n_docs": len(doc_ids),
        "n_ids": len(flat), "bits": bits, "doc_ids": np.array(doc_ids, "<i8").tobytes(),
        "doc_lengths": np.array(lengths, "<i8").tobytes(), "payload": pack(flat, bits),
    }


def encoded_blocks(
    batches: Iterable[pa.RecordBatch], words: WordEncoder, shard: int, bits: int, end_id: int, block_ids: int = BLOCK_IDS
) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard from its rows (doc_id, text), in their order."""
    number, doc_ids, lengths, ids, held = 0, [], [], [], 0
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                        ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.binary()),
                        ("doc_lengths", pa.binary()), ("payload", pa.binary())])
    for piece in pieces(batches, "text", ENCODE_BYTES):
        counts, flat = words.encode(text_array(piece.column("text")))
        ends = np.cumsum(counts)
        for doc, stop, count in zip(piece.column("doc_id").to_pylist(), ends.tolist(), counts.tolist()):
            if doc_ids and held + count + 1 > block_ids:
                yield pa.RecordBatch.from_pylist([_block(shard, number, doc_ids, lengths, ids, bits)], schema)
                doc_ids, lengths, ids, held, number = [], [], [], 0, number + 1
            doc_ids.append(doc)
            lengths.append(count + 1)
            ids += [flat[stop - count : stop], np.array([end_id], np.uint32)]
            held += count + 1
    if doc_ids:
        yield pa.RecordBatch.from_pylist([_block(shard, number, doc_ids, lengths, ids, bits)], schema)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 49_408, end_id: int = 2, block_ids: int = BLOCK_IDS,
    partitions: int | None = None,
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write them as blocks in doc_id order.

    ``docs`` has doc_id and text; a null text counts as empty and gives the end id only.
    Null doc_ids come first (stored as NULL_ID), repeated doc_ids stay, next to each other;
    other columns are not read. An empty table gives an empty folder of files.
    Returns the blocks as read back.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    spread = (partitions, "doc_id") if partitions else ("doc_id",)
    ordered = rows.repartitionByRange(*spread).sortWithinPartitions("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return encoded_blocks(batches, encoder(tokenizer), TaskContext.get().partitionId(), bits, end_id, block_ids)

    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)
    return read_blocks(spark, path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Blocks with ``block_start``, the ids of all blocks before.

    Sums run within each shard; only one row per shard (writing task) meets in one task.
    """
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_ids").over(upto), F.lit(0)).alias("_shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_within"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_within")).alias("block_start"))
    return blocks.join(starts, ["shard", "block"])


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and the crc32 of its ids as 32-bit little-endian."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").view(np.uint8)
                crcs = [zlib.crc32(ids[4 * (end - n) : 4 * end]) for n, end in zip(lengths.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8")), pa.array(row["block_start"] + ends - lengths),
                     pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = with_starts(blocks).mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))


def read_ids(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents: only their blocks are read, only their bytes unpacked."""
    wanted = sorted(set(doc_ids))
    hit = F.lit(False)
    for doc in wanted:
        hit = hit | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                starts = np.cumsum(lengths) - lengths
                docs = np.frombuffer(row["doc_ids"], "<i8")
                at = np.flatnonzero(np.isin(docs, wanted))
                ids = [unpack(row["payload"], row["bits"], int(starts[k]), int(lengths[k])).astype(np.int32) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return blocks.filter(hit).mapInArrow(decode, "doc_id bigint, ids array<int>")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the documents as a token file set and return what the files hold, one row per document."""
    path = path or shared_path(docs.sparkSession, "token-files")
    return read_documents(write_token_files(docs, path, tokenizer, **options))
