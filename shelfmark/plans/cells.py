"""Exact dense search that skips cells of vectors.

Vectors lie in folders by cell: that of the nearest of some pivots. A cell keeps the largest and the
least distance of its vectors to the pivot and their largest length. They bound from above what a query
can score in the cell: by the triangle inequality no vector is nearer to the query than the difference
of distances allows, and by Cauchy-Schwarz the score exceeds that of the pivot by at most the length of
the query times the radius. The cells that can reach most are scored first; after that only those whose
bound reaches the k-th score. The k best are exact for vectors of any length.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import vectors as V
from shelfmark.operators.catalog import Filters
from shelfmark.operators.ranking import top_k
from shelfmark.plans import dense as D
from shelfmark.plans.search import best_first, restrict
from shelfmark.session import materialised, shared_path

# Pivots are vectors that the driver and every task hold: the root of the number of vectors, and at most so many.
MOST_CELLS = 1024
# Cells per query that are scored before others are given up.
FIRST_CELLS = 2
# Bounds are sums of doubles in another order than scores; bounds are taken this much higher.
ROUNDING = 1e-9
# Distances come from products; so much of the lengths at hand may be lost in them.
LOST = 1e-6
# Queries that one task of the grid holds at most, and their bytes; so many tasks per core are aimed at.
HELD_QUERIES = 100_000
HELD_BYTES = 64 << 20
TASKS_PER_CORE = 4
# Scores are worked out in blocks of so many vectors and queries, which the caches hold; so many hits are kept before they are cut to the best.
BLOCK_VECTORS = 512
BLOCK_QUERIES = 2048
KEPT_HITS = 200_000
# Single precision tells which scores may reach a floor, if vectors are no longer than this and at most this share of a block does.
SINGLE_LENGTH = 1e15
SINGLE_SHARE = 0.1


@dataclass(frozen=True)
class Cells:
    """vectors (dataset_id, vector, distance, length, cell); cells (cell, centre, n, nearest, radius, length)."""

    vectors: DataFrame
    cells: DataFrame


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Different stored vectors, the first by a hash of their id; fewer than asked if many of those are equal."""
    first = vectors.filter("vector is not null").orderBy(F.xxhash64("dataset_id"), "dataset_id").select("vector").limit(cells)
    rows = V.block(first.toArrow().column("vector"))
    return np.unique(rows, axis=0) if len(rows) else rows


def build_cells(vectors: DataFrame, cells: int | None = None, folder: str | None = None) -> Cells:
    """The vectors (dataset_id, vector) by cell, kept in ``folder`` or a new one in the shared folder.

    Rows without a vector have no score and are left out. A cell may hold any share of the vectors:
    its files are cut by size, so no task holds a cell.
    """
    if cells is None:
        cells = min(max(isqrt(vectors.count()), 1), MOST_CELLS)
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be from 1 to {MOST_CELLS}")
    spark = vectors.sparkSession
    folder = folder or shared_path(spark, "cells")
    centres = pivots(vectors, cells)
    step = max(1, D.BLOCK_SCORES // max(1, len(centres)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = V.block(part.column("vector"))
                distances = _distances(rows, centres)
                cell = np.argmin(distances, axis=1)
                # Not from the product: what is close must not be lost in rounding.
                nearest = np.sqrt(((rows - centres[cell]) ** 2).sum(1))
                columns = [part.column("dataset_id"), part.column("vector"), pa.array(cell, pa.int32()), pa.array(nearest), pa.array(np.sqrt((rows**2).sum(1)))]
                yield pa.RecordBatch.from_arrays(columns, ["dataset_id", "vector", "cell", "distance", "length"])

    kind = vectors.schema["vector"].dataType.simpleString()
    given = vectors.filter("vector is not null").select("dataset_id", "vector")
    placed = given.mapInArrow(place, f"dataset_id string, vector {kind}, cell int, distance double, length double").hint("rebalance", "cell")
    placed.sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    stored = _stored(spark, folder, kind)
    facts = stored.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("radius"), F.max("length").alias("length")
    )
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").withColumn("centre", F.col("centre").cast(kind))
    facts.join(F.broadcast(middle), "cell").coalesce(1).write.parquet(f"{folder}/cells")
    return load_cells(spark, folder)


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    # Named, as a table without a vector has no file that tells it.
    return spark.read.schema(f"dataset_id string, vector {kind}, distance double, length double, cell int").parquet(f"{folder}/vectors")


def load_cells(spark: SparkSession, folder: str) -> Cells:
    """What build_cells has left in a folder."""
    cells = spark.read.parquet(f"{folder}/cells")
    return Cells(_stored(spark, folder, cells.schema["centre"].dataType.simpleString()), cells)


@dataclass(frozen=True)
class Heads:
    """What is known of each cell, by cell number: at most MOST_CELLS rows, which every task holds."""

    numbers: np.ndarray
    n: np.ndarray
    nearest: np.ndarray
    radius: np.ndarray
    length: np.ndarray
    centres: np.ndarray

    @classmethod
    def of(cls, index: Cells) -> "Heads":
        rows = index.cells.orderBy("cell").toArrow()
        return cls(*(np.asarray(rows.column(c)) for c in ("cell", "n", "nearest", "radius", "length")), V.block(rows.column("centre")))

    @cached_property
    def step(self) -> int:
        """Queries whose bounds are worked out at a time."""
        return max(1, D.BLOCK_SCORES // max(1, len(self.numbers)) // 4)

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """What each query can score in each cell."""
        if not len(self.numbers):
            return np.empty((len(rows), 0))
        spread = np.sqrt((self.centres**2).sum(1))
        size = np.sqrt((rows**2).sum(1))[:, None]
        away = _distances(rows, self.centres)
        gap = np.maximum(np.maximum(away - self.radius, self.nearest - away) - LOST * (size + spread), 0)
        by_triangle = (size**2 + self.length**2 - gap**2) / 2
        best = np.minimum(np.minimum(by_triangle, rows @ self.centres.T + size * self.radius), size * self.length)
        return np.nan_to_num(best + ROUNDING * (1 + size * self.length), nan=np.inf, posinf=np.inf)


def _asked(queries: DataFrame) -> DataFrame:
    """Queries with a vector, as floats or doubles."""
    kind = queries.schema["vector"].dataType.simpleString()
    vector = F.col("vector") if kind == "array<float>" else F.col("vector").cast("array<double>")
    return queries.filter("vector is not null").select("query_id", vector.alias("vector"))


def cell_bounds(index: Cells, queries: DataFrame) -> DataFrame:
    """(query_id, vector, reach array<struct<cell, bound>>): what a query can score in each cell, best first."""
    heads = Heads.of(index)
    reach_type = pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64())]))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, heads.step):
                part = batch.slice(start, heads.step)
                best = heads.bounds(V.block(part.column("vector")))
                order = np.argsort(-best, axis=1, kind="stable")
                values = np.take_along_axis(best, order, axis=1).ravel()
                pairs = pa.StructArray.from_arrays([pa.array(heads.numbers[order].ravel(), pa.int32()), pa.array(values)], ["cell", "bound"])
                offsets = pa.array(np.arange(part.num_rows + 1) * len(heads.numbers), pa.int32())
                columns = [part.column("query_id"), part.column("vector"), pa.ListArray.from_arrays(offsets, pairs).cast(reach_type)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vector", "reach"])

    asked = _asked(queries)
    return asked.mapInArrow(bound, f"query_id string, vector {asked.schema['vector'].dataType.simpleString()}, reach array<struct<cell:int,bound:double>>")


def _bits(wanted: np.ndarray) -> pa.Array:
    """Rows of booleans as a bit per cell."""
    bits = np.packbits(wanted, axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def _wanted(bits: pa.Array | pa.ChunkedArray, first: int, end: int) -> np.ndarray:
    """The booleans of the cells from ``first`` to before ``end``, in the order of their numbers."""
    if not len(bits):
        return np.empty((0, end - first), bool)
    rows = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1)
    return np.unpackbits(rows[:, first // 8 : -(-end // 8)], axis=1)[:, first % 8 : first % 8 + end - first].astype(bool)


def _choose(heads: Heads, queries: DataFrame, first_cells: int | None) -> DataFrame:
    """(query_id, vector, least, wanted, n): a bit per cell that a query wants, and their number.

    The ``first_cells`` that can reach most; without that, all whose bound reaches ``least`` but those ``wanted`` before.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if len(heads.numbers) else 0, heads.step):
                part = batch.slice(start, heads.step)
                best = heads.bounds(V.block(part.column("vector")))
                if first_cells is None:
                    least = pc.fill_null(part.column("least"), -np.inf).to_numpy()
                    wanted = (best >= least[:, None]) & ~_wanted(part.column("wanted"), 0, len(heads.numbers))
                else:
                    wanted = np.zeros(best.shape, bool)
                    n = min(first_cells, best.shape[1])
                    if n:
                        np.put_along_axis(wanted, np.argpartition(-best, n - 1, axis=1)[:, :n], True, axis=1)
                counts = wanted.sum(1)
                columns = [*(part.column(c) for c in ("query_id", "vector", "least")), _bits(wanted), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vector", "least", "wanted", "n"]).filter(pa.array((counts > 0) | (first_cells is not None)))

    return queries.mapInArrow(choose, f"query_id string, vector {queries.schema['vector'].dataType.simpleString()}, least double, wanted binary, n int")


class _Best:
    """The k best hits so far of every query of a matrix, among the vectors of the cells it wants."""

    def __init__(self, asked: pa.Table, k: int, first: int, cells: np.ndarray):
        """``cells`` are the numbers of the cells that may come, of which the first is the ``first`` in the order of all."""
        self.matrix, self.k, self.cells = V.block(asked.column("vector")), k, cells
        self.wanted = _wanted(asked.column("wanted"), first, first + len(cells))
        # Scores below are no hits; a query that has k hits needs no worse ones.
        self.floor = pc.fill_null(asked.column("least"), -np.inf).to_numpy().copy()
        self.lengths = np.sqrt((self.matrix**2).sum(1))
        most = BLOCK_VECTORS * min(BLOCK_QUERIES, len(self.matrix))
        self.room = np.empty(most, np.float32), np.empty(most, bool)
        self.single = self.matrix.astype(np.float32) if self.lengths.max(initial=0) < SINGLE_LENGTH else None
        self.hits: list[V.Best] = []
        self.held, self.most = 0, KEPT_HITS

    def add(self, batch: pa.RecordBatch) -> None:
        """Vectors (dataset_id, vector, cell)."""
        cells = np.asarray(batch.column("cell"))
        order = np.argsort(cells, kind="stable")
        batch, cells = batch.take(pa.array(order)), cells[order]
        for cell in np.unique(cells).tolist():
            at = int(np.searchsorted(self.cells, cell))
            rows = np.flatnonzero(self.wanted[:, at])
            begin, end = np.searchsorted(cells, [cell, cell + 1]).tolist() if len(rows) else (0, 0)
            for start in range(begin, end, BLOCK_VECTORS):
                part = batch.slice(start, min(BLOCK_VECTORS, end - start))
                vectors, names = V.block(part.column("vector")), np.asarray(part.column("dataset_id").to_pylist(), dtype=str)
                for some in range(0, len(rows), BLOCK_QUERIES):
                    self._score(rows[some : some + BLOCK_QUERIES], vectors, names)

    def _score(self, rows: np.ndarray, vectors: np.ndarray, names: np.ndarray) -> None:
        pick = slice(rows[0], rows[-1] + 1) if rows[-1] - rows[0] + 1 == len(rows) else rows
        floor = self.floor[rows]
        found = self._found(pick, vectors, floor)
        if found is None:
            scores = vectors @ self.matrix[pick].T
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and len(vectors) >= self.k and not np.isnan(scores).any():
                floor[new] = np.round(np.partition(scores[:, new], len(vectors) - self.k, axis=0)[len(vectors) - self.k], D.SCORE_DECIMALS)
                self.floor[rows] = floor
            # Scores that are rounded up to the floor are hits too.
            place, row = np.divmod(np.flatnonzero(scores >= floor - 10.0**-D.SCORE_DECIMALS - 4e-15 * np.abs(floor)), len(rows))
            found = place, row, scores[place, row]
        place, row, values = found
        values = np.round(values, D.SCORE_DECIMALS)
        kept = (values >= floor[row]) & (values > -np.inf)
        self.hits.append((rows[row[kept]], values[kept], names[place[kept]]))
        self.held += int(kept.sum())
        if self.held > self.most:
            self.cut()

    def _found(self, pick: slice | np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Vectors, queries and scores that may reach the floors, told by products in single precision; None if those do not tell much."""
        longest = np.sqrt((vectors**2).sum(1).max())
        if self.single is None or not longest < SINGLE_LENGTH or not (floor > -np.inf).all():
            return None
        # What rounding of numbers, products and sums may lose, twice.
        lost = (vectors.shape[1] + 8) * np.finfo(np.float32).eps * self.lengths[pick] * longest
        low = (floor - lost - 1e-6 * np.abs(floor) - 1e-11).astype(np.float32)
        shape = len(vectors), len(floor)
        # The same memory each time: new pages would take longer than the products.
        products, reach = (room[: len(vectors) * len(floor)].reshape(shape) for room in self.room)
        np.matmul(vectors.astype(np.float32), self.single[pick].T, out=products)
        at = np.flatnonzero(np.greater_equal(products, low, out=reach))
        if len(at) > SINGLE_SHARE * len(vectors) * len(floor):
            return None
        place, row = np.divmod(at, len(floor))
        (places, i), (queries, j) = np.unique(place, return_inverse=True), np.unique(row, return_inverse=True)
        return place, row, (vectors[places] @ self.matrix[pick][queries].T)[i, j]

    def cut(self) -> V.Best:
        """Only the k best of each query stay (score descending, id ascending)."""
        if not self.hits:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, str)
        rows, values, names = map(np.concatenate, zip(*self.hits))
        order = np.lexsort((-values, rows))
        ends = np.searchsorted(rows[order], rows[order], side="left") + self.k
        last = np.minimum(ends, np.searchsorted(rows[order], rows[order], side="right")) - 1
        order = order[values[order] >= values[order][last]]
        # Ids are compared only where they may decide.
        order = order[np.lexsort((names[order], -values[order], rows[order]))]
        rows, values, names = rows[order], values[order], names[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kth = rank == self.k - 1
        self.floor[rows[kth]] = np.maximum(self.floor[rows[kth]], values[kth])
        best = rows[rank < self.k], values[rank < self.k], names[rank < self.k]
        self.hits, self.held = [best], len(best[0])
        self.most = max(KEPT_HITS, 2 * self.held)
        return best


_COLUMNS = ("query_id", "vector", "least", "wanted")


def _scan_cells(heads: Heads, stored: DataFrame, wanted: pa.Table, k: int) -> DataFrame:
    """The k best per query and task, where the vectors lie; only folders of wanted cells are read."""
    shared = stored.sparkSession.sparkContext.broadcast(wanted)
    cells = heads.numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        best = _Best(wanted, k, 0, cells) if wanted.num_rows else None
        for batch in batches if best else ():
            best.add(batch)
        if best:
            yield V.hits_of(np.asarray(wanted.column("query_id").to_pylist(), dtype=str), best.cut())

    read = cells[_wanted(wanted.column("wanted"), 0, len(cells)).any(0)] if wanted.num_rows else cells[:0]
    return stored.filter(F.col("cell").isin(read.tolist())).select("dataset_id", "vector", "cell").mapInArrow(scan, V.HITS)


def _bin_size(vectors: int, queries: int, cells: float, held: int, tasks: int) -> int:
    """Vectors of a bin, so that few rows are copied: a vector to each block of queries of its bin, a query to each bin of its ``cells``."""
    fewest = max(1, -(-vectors // D.GRID_VECTORS))

    def copies(bins: int) -> float:
        reached = min(bins, cells)
        blocks = max(-(-queries * reached / bins // held), tasks / bins, 1)
        return vectors * blocks + queries * reached

    return max(1, -(-vectors // min((b for b in {*range(fewest, fewest + 64), *(fewest * 2**i for i in range(11))} if b <= max(fewest, MOST_CELLS)), key=lambda b: (copies(b), b))))


def _bins(heads: Heads, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring cells packed to bins of ``size`` vectors: where each bin begins among the cells, and its vectors."""
    begins, sizes = [], []
    for at, n in enumerate(heads.n.tolist()):
        if sizes and sizes[-1] + n <= size:
            sizes[-1] += n
        else:
            begins.append(at)
            sizes.append(n)
    return np.array(begins), np.array(sizes)


def _reached(bits: pa.Array, begins: np.ndarray, cells: int) -> np.ndarray:
    """Which bins hold a wanted cell: a row per query."""
    return np.logical_or.reduceat(_wanted(bits, 0, cells), begins, axis=1)


def _spread(spark: SparkSession, n: int) -> list[int]:
    """So many numbers that a shuffle by them deals out evenly."""
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(16 * max(n, shares)).select("id", F.pmod(F.hash("id"), F.lit(shares)).alias("share")).toArrow()
    ids, share = np.asarray(rows.column("id")), np.asarray(rows.column("share"))
    order = np.argsort(share, kind="stable")
    turn = np.empty_like(share)
    turn[order] = np.arange(len(share)) - np.searchsorted(share[order], share[order], side="left")
    return ids[np.lexsort((share, turn))][:n].tolist()


def _grid_cells(heads: Heads, stored: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Bins of cells and the queries that want some of them, cut into bounded parts; one task scores one part against one other.

    A query is copied to each part of a bin, not to each cell.
    """
    cells, dimensions = len(heads.numbers), heads.centres.shape[1]
    held = max(1, min(HELD_QUERIES, HELD_BYTES // (8 * max(1, dimensions))))
    asked = wanted.agg(F.count("*").alias("n"), F.avg("n").alias("cells")).first()
    tasks = TASKS_PER_CORE * stored.sparkSession.sparkContext.defaultParallelism
    size = _bin_size(int(heads.n.sum()), asked["n"], asked["cells"] or 1.0, held, tasks)
    begins, sizes = _bins(heads, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(begins), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, heads.step):
                total += _reached(batch.column("wanted").slice(start, heads.step), begins, cells).sum(0)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(len(begins)), pa.int32()), "n": pa.array(total)})

    # One row per bin: at most MOST_CELLS.
    counts = {r["bin"]: r["n"] for r in wanted.select("wanted").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    parts = [-(-n // size) for n in sizes.tolist()]
    # Blocks of the bounded size, and as many as give the tasks wanted.
    blocks = [min(n, max(-(-n // held), round(tasks / sum(parts)))) for n in (counts.get(b, 0) for b in range(len(parts)))]
    lookup = np.full(int(heads.numbers.max(initial=0)) + 1, -1)
    lookup[heads.numbers] = np.repeat(np.arange(len(begins)), np.diff([*begins, cells]))
    bin_of, part_of, blocks_of = (F.array(*[F.lit(int(n)).cast("int") for n in numbers]) for numbers in (lookup, parts, blocks))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    each = lambda numbers: F.get(numbers, F.col("bin"))
    left = stored.withColumn("bin", F.get(bin_of, F.col("cell"))).filter(each(blocks_of) > 0)
    part = F.pmod(F.xxhash64("dataset_id"), each(part_of)).cast("int").alias("part")
    left = left.select("dataset_id", "vector", "cell", "bin", part, upto(each(blocks_of)).alias("block"))
    slots = _spread(stored.sparkSession, sum(p * b for p, b in zip(parts, blocks)))
    slot_of, begin_of = F.array(*[F.lit(n) for n in slots]), F.array(*[F.lit(int(n)) for n in np.cumsum([0, *(p * b for p, b in zip(parts, blocks))])])
    slot = F.get(slot_of, each(begin_of) + F.col("part") * each(blocks_of) + F.col("block")).cast("bigint").alias("slot")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, heads.step):
                rows = batch.slice(start, heads.step)
                reached = _reached(rows.column("wanted"), begins, cells)
                offsets = pa.array(np.concatenate(([0], np.cumsum(reached.sum(1)))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(reached)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*_COLUMNS, "bins"])

    kind = wanted.schema["vector"].dataType.simpleString()
    dealt = wanted.select(*_COLUMNS).mapInArrow(deal, f"query_id string, vector {kind}, least double, wanted binary, bins array<int>")
    block = F.pmod(F.xxhash64("query_id"), each(blocks_of)).cast("int").alias("block")
    right = dealt.select(*_COLUMNS, F.explode("bins").alias("bin")).select(*_COLUMNS, "bin", block, upto(each(part_of)).alias("part"))
    ends = [*begins[1:].tolist(), cells]

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "dataset_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        at = asked.column("bin")[0].as_py()
        found = _Best(asked, k, int(begins[at]), heads.numbers[begins[at] : ends[at]])
        for batch in held.combine_chunks().to_batches():
            found.add(batch)
        return pa.Table.from_batches([V.hits_of(np.asarray(asked.column("query_id").to_pylist(), dtype=str), found.cut())])

    left, right = left.select("dataset_id", "vector", "cell", slot), right.select(*_COLUMNS, "bin", slot)
    return left.groupBy("slot").cogroup(right.groupBy("slot")).applyInArrow(best, V.HITS)


def _scores(heads: Heads, stored: DataFrame, wanted: DataFrame, k: int, broadcast_queries: int) -> DataFrame:
    """(query_id, dataset_id, score): hits of the wanted cells, all of the k best among them."""
    some = wanted.select(*_COLUMNS).limit(broadcast_queries + 1).toArrow()
    if some.num_rows <= broadcast_queries:
        return _scan_cells(heads, stored, some, k)
    return _grid_cells(heads, stored, wanted, k)


def search_cells(
    index: Cells,
    queries: DataFrame,
    k: int,
    datasets: DataFrame | None = None,
    filters: Filters | None = None,
    first_cells: int = FIRST_CELLS,
    broadcast_queries: int = D.BROADCAST_QUERIES,
) -> DataFrame:
    """(query_id, rank, dataset_id, score): the rows of ``dense.search_dense_batch``, from fewer vectors."""
    stored = index.vectors.select("dataset_id", "vector", "cell")
    if datasets is not None:
        stored = restrict(stored, datasets, filters)
    first, further = choose_cells(index, stored, queries, k, first_cells, broadcast_queries)
    hits = first.unionByName(_scores(Heads.of(index), stored, further, k, broadcast_queries))
    return top_k(hits, ["query_id"], best_first(), k).select("query_id", "rank", "dataset_id", "score")


def choose_cells(
    index: Cells, stored: DataFrame, queries: DataFrame, k: int, first_cells: int = FIRST_CELLS, broadcast_queries: int = D.BROADCAST_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """(hits of the first cells, (query_id, vector, least, wanted, n, cells) of cells that can still hold one of the k best)."""
    # Bounds are worked out twice, as keeping all of them would take more room than the queries.
    heads = Heads.of(index)
    first = materialised(_choose(heads, _asked(queries).withColumn("least", F.lit(None).cast("double")), first_cells), "first-cells")
    scored = materialised(_scores(heads, stored, first, k, broadcast_queries), "first-hits")
    kth = top_k(scored, ["query_id"], best_first(), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    further = first.select("query_id", "vector", "wanted").join(kth, "query_id", "left").select(*_COLUMNS)
    further = materialised(_choose(heads, further, None), "further-cells")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(bits: pa.Array) -> pa.Array:
        return pa.array([heads.numbers[w] for w in _wanted(bits, 0, len(heads.numbers))], pa.list_(pa.int32()))

    return scored, further.withColumn("cells", cells("wanted"))
