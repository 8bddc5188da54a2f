"""Conversation repair: faults of rows, and the cheapest edits that make roles alternate, as Spark jobs.

The edits are found by the block tables of ``turn_grammar``. A conversation may hold any share of
all rows, so none is gathered in a task for it:

- rows are sorted by conversation and turn into slices (without texts; equal rows count as one
  row with a number of copies), and a conversation that crosses slices is cut there;
- each slice says what its first and last conversation do for every cost vector on their right, which
  is a few hundred bytes; per conversation these are chained from the end, then from the start;
- with the vector on its right and the state on its left known, each slice writes the edits of its rows;
- last, texts and edits meet, in order: a repaired conversation has one digest and one string of
  edits, so its rows stream through one task, which holds none of them.

Rows of one conversation are in the order of their turns, null first; of equal turns by role, then by a
digest of role and text. Equality of texts is that of SHA-256.

Defined results: null roles and texts are one space, so such a text is blank and such a role must be
changed or deleted, as an empty role must; a null conv_id is a conversation of its own; a row whose turn is
null takes part in all but ``gaps``; repeated rows are duplicates; a conversation without rows gives
zeros, an empty audit and the digest of the empty string; other columns are not looked at.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import turn_grammar as G
from shelfmark.llm.texts import give_back_memory, written

SPACES = " \t\n\x0b\x0c\r"
FULL_STOPS = ".!?"
# Finished rows are passed on when this many wait.
ROWS_AT_ONCE = 20_000


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query, by a checksum of conversation and turn; each row with its number of copies."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(plain("text"), FULL_STOPS, "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).filter("copies > 0")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows without texts in slices of the order, with their symbol: what their first copy is, and how many follow."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.substr("role", F.lit(1), F.lit(1))
    code = F.when(initial == "s", 1).when(initial == "u", 3).when(initial == "a", 5).otherwise(7)
    whole = end.isin(*FULL_STOPS)
    narrow = rows.select("conv_id", "turn", "role", "same", "copies", (end == "").alias("blank"), F.when(end == "", 0).otherwise(code + F.when(whole, 0).otherwise(1)).cast("int").alias("symbol"))
    order = ("conv_id", "turn", "role", "same")
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns-in-order")
    # The row numbers of a partition begin at its number times 2^33.
    placed = placed.withColumn("slice", F.shiftright("pos", 33))
    first = placed.filter("not blank").groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("same").alias("as"), "first")
    seen = placed.join(first, placed["conv_id"].eqNullSafe(F.col("of")) & (placed["same"] == F.col("as")), "left")
    repeats = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    return seen.select("slice", "pos", "conv_id", "turn", "role", "same", "copies", "blank", repeats.alias("repeats"), F.when(repeats, 0).otherwise(F.col("symbol")).alias("symbol"))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it; null equals null."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return differ | (valid[1:] != valid[:-1])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by slice and conversation (columns 0 and 1) in whole stretches of both, with the bounds of these."""

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(_changes(rows.column(0)) | _changes(rows.column(1))) + 1
        return rows, np.concatenate(([0], starts, [rows.num_rows]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        bounds = joined([*edge, batch])[1]
        starts = bounds[1:-1] - len(edge)
        if not len(starts):
            held.append(batch)
            continue
        yield joined([*held, *([batch.slice(0, starts[-1])] if starts[-1] else [])])
        held = [batch.slice(starts[-1])]
    if held:
        yield joined(held)
    give_back_memory()


def _symbols(rows: pa.RecordBatch, start: int, stop: int) -> np.ndarray:
    """The symbols of a stretch, copies written out: all but the first must go. Rows with symbol -1 have none."""
    codes = rows.column("symbol").to_numpy()[start:stop]
    copies = rows.column("copies").to_numpy()[start:stop]
    kept = codes >= 0
    codes, copies = codes[kept], copies[kept]
    out = np.zeros(int(copies.sum()), np.int64)
    out[np.cumsum(copies) - copies] = codes
    return out


def _edges(marked: DataFrame) -> DataFrame:
    """What the first and the last conversation of each slice do: their right vectors to left ones and states."""
    kind = marked.schema["conv_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(rows: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
            left, state = G.stretch(_symbols(rows, start, stop))
            head = rows.slice(start, 1)
            return pa.RecordBatch.from_arrays(
                [head.column("slice"), head.column("conv_id"), head.column("pos"), pa.array([left.tobytes()]), pa.array([state.tobytes()])], ["slice", "conv_id", "pos", "left", "state"]
            )

        last, waiting = None, None
        for rows, bounds in _stretches(batches):
            slices = rows.column("slice").to_numpy()
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                if slices[start] != last:
                    if waiting is not None:
                        yield row(*waiting)
                    yield row(rows, start, stop)
                    last, waiting = slices[start], None
                else:
                    waiting = rows, start, stop
        if waiting is not None:
            yield row(*waiting)

    by_slice = marked.select("slice", "conv_id", "pos", "symbol", "copies").repartition("slice").sortWithinPartitions("slice", "pos")
    return by_slice.mapInArrow(build, f"slice bigint, conv_id {kind}, pos bigint, left binary, state binary")


def _chained(edges: DataFrame) -> DataFrame:
    """For each piece of a conversation that crosses slices, the vector on its right and the state on its left.

    One conversation has at most one piece per slice here, of about 200 bytes.
    """
    kind = edges.schema["conv_id"].dataType.simpleString()

    def chain(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("pos")
        left = [np.frombuffer(x, np.uint16) for x in pieces["left"].to_pylist()]
        behind = [np.frombuffer(x, np.uint8).reshape(-1, G.STATES) for x in pieces["state"].to_pylist()]
        right = [G.AT_END]
        for table in left[:0:-1]:
            right.append(int(table[right[-1]]))
        right.reverse()
        state = [0]
        for table, vector in zip(behind[:-1], right, strict=False):
            state.append(int(table[vector, state[-1]]))
        return pa.table({"slice": pieces["slice"], "conv_id": pieces["conv_id"], "pos": pieces["pos"], "right_vector": pa.array(right, pa.int32()), "left_state": pa.array(state, pa.int32())})

    return edges.groupBy("conv_id").applyInArrow(chain, f"slice bigint, conv_id {kind}, pos bigint, right_vector int, left_state int")


def edits(marked: DataFrame) -> DataFrame:
    """The rows with the letters of their edits; of a row with copies those of all of them."""
    kinds = {c: marked.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    known = written(_chained(_edges(marked)), "turn-edges")
    columns = ["slice", "conv_id", "pos", "turn", "role", "same", "copies", "blank", "repeats", "symbol"]
    rows = marked.select(*columns, F.lit(None).cast("int").alias("right_vector"), F.lit(None).cast("int").alias("left_state"))
    heads = known.select("slice", "conv_id", "pos", *[F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in columns[3:6]], F.lit(0).alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("repeats"), F.lit(-1).alias("symbol"), "right_vector", "left_state")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _stretches(batches):
            codes, copies = rows.column("symbol").to_numpy(), rows.column("copies").to_numpy()
            right, state = rows.column("right_vector"), rows.column("left_state")
            letters: list[str | None] = []
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                around = (G.AT_END, 0)
                if codes[start] < 0:
                    around = right[start].as_py(), state[start].as_py()
                    start += 1
                    letters.append(None)
                found, _ = G.letters_of(_symbols(rows, start, stop), *around)
                if copies[start:stop].max(initial=1) == 1:
                    letters += found
                else:
                    ends = np.cumsum(copies[start:stop]).tolist()
                    letters += ["".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            done = pa.RecordBatch.from_arrays([*rows.columns[1:2], *rows.columns[3:9], pa.array(letters, pa.string())], ["conv_id", *columns[3:9], "letters"])
            yield done.filter(pa.array(codes >= 0))

    # The head of a piece comes right before its first row.
    both = rows.withColumn("is_row", F.lit(1)).unionByName(heads.withColumn("is_row", F.lit(0)))
    by_slice = both.repartition("slice").sortWithinPartitions("slice", "pos", "is_row").drop("is_row")
    return by_slice.mapInArrow(build, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, same binary, copies bigint, blank boolean, repeats boolean, letters string")


class Repaired:
    """A conversation as its rows come by."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.turns, self.low, self.high = 0, None, None
        self.before: str | None = None
        self.audit: list[str] = []
        self.state, self.lines = 0, 0
        self.digest = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def row(self, turn, role: str, text: str, copies: int, blank: bool, repeats: bool, truncated: bool, letters: str) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.before = initial
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies if repeats else copies - 1
        cut = truncated and not blank and not repeats
        self.truncated += cut
        self.audit.append(letters)
        for letter in letters:
            if letter == "D":
                self.cost += G.DELETE
            elif letter == "I":
                self.line(G.ROLE[self.state], "")
                self.cost, self.state = self.cost + G.INSERT, G.NEXT[self.state]
            else:
                self.cost += G.TRUNCATED * cut + (G.REROLE if letter == "R" else 0)
                self.line(G.ROLE[self.state] if letter == "R" else role, text)
                self.state = G.NEXT[self.state] if letter == "R" else G.KEPT[initial][self.state]

    def result(self) -> tuple:
        for _ in G.TAIL[self.state]:
            self.line(G.ROLE[self.state], "")
            self.audit.append("I")
            self.cost, self.state = self.cost + G.INSERT, G.NEXT[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The faults, audit and repaired digest of each conversation named in ``every``.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two) and copies.
    """
    same = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    single = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    single = written(single.withColumn("same", same), "turns")
    done = edits(written(in_order(single), "turns-marked"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    kind = {c: single.schema[c].dataType for c in ("conv_id", "turn")}

    def none(name: str, type_: str) -> Column:
        return F.lit(None).cast(type_).alias(name)

    texts = single.select("conv_id", "turn", "role", "same", F.lit(2).alias("part"), "text", (~end.isin(*FULL_STOPS)).alias("truncated"), none("copies", "bigint"), none("blank", "boolean"), none("repeats", "boolean"), none("letters", "string"))
    found = done.select("conv_id", "turn", "role", "same", F.lit(1).alias("part"), none("text", "string"), none("truncated", "boolean"), "copies", "blank", "repeats", "letters")
    named = every.select("conv_id").distinct().select("conv_id", F.lit(None).cast(kind["turn"]).alias("turn"), none("role", "string"), none("same", "binary"), F.lit(0).alias("part"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in texts.columns[5:]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        results: list[tuple] = []
        talk, edit = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                columns = zip(*results, strict=True)
                arrays = [pa.array(c, pa.string() if n in RESULT[-2:] else pa.int64()) for n, c in zip(RESULT, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], ["conv_id", *RESULT])
                ids.clear()
                results.clear()

        for batch in batches:
            names = batch.column("conv_id")
            columns = [batch.column(c).to_pylist() for c in ("turn", "role", "part", "text", "truncated", "copies", "blank", "repeats", "letters")]
            for i, (turn, role, part, text, truncated, copies, blank, repeats, letters) in enumerate(zip(*columns, strict=True)):
                if part == 0:  # the first of each conversation
                    if talk is not None:
                        results.append(talk.result())
                    ids.append(names.slice(i, 1))
                    talk = Repaired()
                elif part == 1:
                    edit = copies, blank, repeats, letters
                else:
                    talk.row(turn, role, text, *edit[:3], truncated, edit[3])
            if len(results) >= ROWS_AT_ONCE:
                open_id = ids.pop()
                yield from flush()
                ids.append(open_id)
        if talk is not None:
            results.append(talk.result())
        yield from flush()
        give_back_memory()

    ordered = texts.unionByName(found).unionByName(named).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "same", "part")
    kinds = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return ordered.mapInArrow(build, f"conv_id {kind['conv_id'].simpleString()}, {kinds}")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations damaged and repaired."""
    return repair(damaged(conversations), conversations)
