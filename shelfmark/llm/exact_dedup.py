"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each sender (a task over whole texts) hashes its normalised texts. Per owner (a range
   of fingerprints) it sends its sorted distinct fingerprints, Golomb-Rice coded: about
   two bits more than the logarithm of the mean gap, instead of 64.
2. Owners decode the lists of all senders, and answer each with a bitmap of the
   fingerprints that another sender has as well. What repeats within a sender, it knows itself.
3. Texts marked either way are suspects. Only they are shuffled, grouped by their whole
   bytes; texts that others lack never leave their task.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.id_filter import may_be_in
from shelfmark.llm.texts import pieces, text_array, written

# An owner's share of the fingerprints, so that its lists fit in memory.
OWNER_ROWS = 1_000_000
MOST_OWNERS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    """A-Z lower-cased, all else as it is; null as empty."""
    return F.coalesce(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(""))


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct unsigned integers. Returns (k, bytes).

    The gaps' quotients by 2^k come first in unary, then all their low k bits, so that both
    parts are read without a loop.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, (int(values[-1]) // len(values)).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :]
    return k, np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(k: int, count: int, blob: bytes) -> np.ndarray:
    """The integers of ``rice_encode``."""
    if not count:
        return np.empty(0, np.uint64)
    split = len(blob) - (count * k + 7) // 8
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(blob[:split], np.uint8)) == 0)[:count]
    quotients = np.diff(stops, prepend=-1) - 1
    low = np.zeros((count, 64), np.uint8)
    low[:, 64 - k :] = np.unpackbits(np.frombuffer(blob[split:], np.uint8))[: count * k].reshape(count, k)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


_PRINTS = "sender int, owner int, place int, first boolean, twice boolean, doc_id bigint, text_sha256 string, print bigint"


def _fingerprints(docs: DataFrame, owners: int) -> DataFrame:
    """One row per text: its hash, its owner, and its place in the sender's sorted list for that owner.

    ``twice`` marks a fingerprint that the sender has more than once, ``first`` one row of each.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        ids, digests = [], []
        for piece in pieces(batches, "text"):
            ids.append(piece.column("doc_id").cast(pa.int64()))
            texts = text_array(piece.column("text"))
            digests += [hashlib.sha256(t.as_buffer().to_pybytes().lower()).digest() for t in texts]
        if not digests:
            return
        prints = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        run = np.cumsum(starts) - 1
        owner = (ordered >> np.uint64(48)).astype(np.int64) * owners >> 16
        first_of_owner = np.concatenate(([True], owner[1:] != owner[:-1]))
        base = np.maximum.accumulate(np.where(first_of_owner, run, 0))
        twice = np.bincount(run)[run] > 1
        ids = pa.concat_arrays(ids).take(pa.array(order))
        hexes = pa.array([digests[i].hex() for i in order.tolist()])
        size = len(order)
        columns = [
            pa.array(np.full(size, sender, np.int32)), pa.array(owner.astype(np.int32)), pa.array((run - base).astype(np.int32)),
            pa.array(starts), pa.array(twice), ids, hexes, pa.array(ordered.view(np.int64)),
        ]
        names = [field.split()[0] for field in _PRINTS.split(", ")]
        for at in range(0, size, 50_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names)

    return docs.mapInArrow(build, _PRINTS)


def _lists(prints: DataFrame) -> DataFrame:
    """Per sender and owner, the sorted distinct fingerprints as one coded list."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            values = np.concatenate(held).view(np.uint64)
            k, blob = rice_encode(values)
            return pa.RecordBatch.from_pylist(
                [{"owner": key[1], "sender": key[0], "k": k, "n": len(values), "blob": blob}],
                pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]),
            )

        for batch in batches:
            sender, owner, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sender", "owner", "print"))
            cuts = np.flatnonzero(np.concatenate(([True], (sender[1:] != sender[:-1]) | (owner[1:] != owner[:-1])))) if len(sender) else []
            for a, b in zip(cuts, [*cuts[1:], len(sender)]):
                now = (int(sender[a]), int(owner[a]))
                if key is not None and now != key:
                    yield row()
                    held = []
                key = now
                held.append(values[a:b])
        if key is not None:
            yield row()

    # A sender writes its rows in order, so its lists are runs; a list cut by a file split is two lists.
    return prints.filter("first").select("sender", "owner", "print").mapInArrow(build, "owner int, sender int, k int, n bigint, blob binary")


def _answers(lists: DataFrame) -> DataFrame:
    """(owner, sender, print) of fingerprints that several senders have, decoded from the owners' bitmaps."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bitmaps(rows: list[dict]) -> pa.RecordBatch:
            each = [rice_decode(r["k"], r["n"], r["blob"]) for r in rows]
            values, counts = np.unique(np.concatenate(each), return_counts=True)
            shared = values[counts > 1]
            maps = [np.packbits(np.isin(e, shared, assume_unique=True)).tobytes() for e in each]
            found = [(r, m) for r, m in zip(rows, maps) if any(m)]
            return pa.RecordBatch.from_pylist(
                [{**r, "bitmap": m} for r, m in found],
                pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), ("bitmap", pa.binary())]),
            )

        owner, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["owner"] != owner and held:
                    yield bitmaps(held)
                    held = []
                owner = row["owner"]
                held.append(row)
        if held:
            yield bitmaps(held)

    schema = "owner int, sender int, k int, n bigint, blob binary, bitmap binary"
    return lists.repartition("owner").sortWithinPartitions("owner", "sender").mapInArrow(answer, schema)


def _marked(answers: DataFrame) -> DataFrame:
    """The fingerprints that a sender's bitmap marks, read against the sender's own list."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = rice_decode(row["k"], row["n"], row["blob"])
                hit = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[: row["n"]].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(values[hit].view(np.int64))], ["print"])

    return answers.mapInArrow(build, "print bigint")


def exact_groups(docs: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (ids are unique; rows with a null id stay unless
    a row with an id is equal). ``docs`` has doc_id and text; other columns are
    not read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    owners = max(1, min(MOST_OWNERS, -(-docs.select("doc_id").count() // owner_rows)))
    prints = written(_fingerprints(docs, owners), "prints")
    shared = written(_marked(_answers(_lists(prints))).distinct(), "shared")
    own = prints.filter("first and twice").select("print")
    suspects = written(prints.join(shared.union(own).distinct(), "print", "left_semi").select("doc_id", "text_sha256"), "suspects")

    # Byte verification: equal means equal as whole strings. A large group is counted before the shuffle.
    ids = suspects.select("doc_id")
    named = ids.distinct().withColumnRenamed("doc_id", "named")
    passed = may_be_in(docs, ids)
    whole = passed.join(named, passed["doc_id"].eqNullSafe(named["named"]), "left_semi").select("doc_id", normalised().alias("whole"))
    groups = whole.groupBy("whole").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.filter("group_size > 1").select(F.sha2(F.col("whole").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    groups = written(groups, "groups")
    return prints.select("doc_id", "text_sha256").join(groups, "text_sha256", "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )


DEDUP_SQL = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS whole FROM documents),
groups AS (SELECT whole, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY whole)
SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, sha256(whole) AS text_sha256
FROM texts JOIN groups USING (whole)"""
