"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Texts whose word-shingle sets reach a Jaccard similarity are linked; linked texts form groups.

1. Every text becomes its set of shingle hashes (64 bits), an odd sketch (a bitmap in
   which each shingle flips one bit) and a prefix: in any one order of all shingles, two
   sets that reach the threshold t share one of the first ``n - ceil(t * n) + 1``. The
   order is by hash, with shingles that many texts share put last.
2. Texts with equal sets are one text from here on.
3. Texts sharing a prefix shingle form a tile; of tiles that hold the same texts one stays.
   Each text is first compared with one or two pivots of each of its tiles, and in large
   tiles with the text whose sketch is nearest; links found are joined to components.
4. Tiles that still hold texts of several components are cut into bounded cells, and all
   pairs of different components and fitting sizes (the size bands) are bounded from above
   by the bits in which their sketches differ: that many shingles differ at least. Of the
   pairs that pass, only a tree over their texts leaves a cell, so fewer rows than texts.
5. Trees that meet make a cluster: it holds both texts of each pair that passed. In a
   cluster all pairs whose sizes fit are compared exactly on their sorted arrays, each in
   one bounded cell; of the links, again only a tree over components leaves a cell.
6. For the number of links, all pairs of each component whose sizes fit are compared
   exactly, each in one bounded cell; only counts per text leave a cell.

No pair that reaches the threshold is lost: it shares a tile, and is then either
compared or found in one component already.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.id_filter import may_be_in, without
from shelfmark.llm.texts import give_back_memory, pieces, shingle_sets, text_array, written

# A shingle seen this often among prefixes goes to the end of the order. At most HOT_SHINGLES
# of them are sent to the tasks (16 bytes each); the others keep their place. Any order is exact.
HOT_COUNT = 40
HOT_SHINGLES = 200_000
# Within a piece of a task, rarer shingles are not reported as candidates for being hot.
HOT_IN_PIECE = 3
CELL_TEXTS = 1024
LARGE_TILE = 16
# Links are counted in cells of two parts of about this many texts and bytes of hashes, so many shingles at a time.
LINK_TEXTS, LINK_BYTES = 512, 16 << 20
LINK_COLUMNS = 4096
# Bits of a sketch per shingle, and the least and most bits: fewer collisions, tighter bounds.
SKETCH_SPREAD = 2
SKETCH_BITS = (64, 16_384)

_SET = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary, short binary, prefix array<bigint>"


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """The number of first shingles of which one is shared by any set similar enough."""
    above, below = threshold
    return n - -(-above * n // below) + 1 if n else 0


def odd_sketch(hashes: np.ndarray) -> bytes:
    """A bitmap of some bits per shingle (within limits); each shingle flips one bit."""
    bits = SKETCH_BITS[0]
    while bits < SKETCH_SPREAD * len(hashes) and bits < SKETCH_BITS[1]:
        bits *= 2
    flips = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def halved(sketch: bytes) -> bytes:
    """The sketch of the same set with half as many bits; the shortest stays."""
    if 8 * len(sketch) <= SKETCH_BITS[0]:
        return sketch
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(2, -1), axis=0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in one of two sets only."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint8)
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(b)), axis=0) if len(a) > len(b) else x
    return int(np.bitwise_count(folded ^ np.frombuffer(b, np.uint8)).sum())


def may_reach(a: bytes, n_a: int, b: bytes, n_b: int, threshold: tuple[int, int]) -> bool:
    """Whether the bits leave room for the threshold.

    With d shingles in one set only, the similarity is (n_a + n_b - d) / (n_a + n_b + d).
    """
    above, below = threshold
    d = differing(a, b)
    return below * (n_a + n_b - d) >= above * (n_a + n_b + d)


def _prefix(hashes: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    length = prefix_length(len(hashes), threshold)
    if not len(hot) or not length:
        return hashes[:length]
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    found = hot[at] == hashes
    counts = np.where(found, hot_counts[at], 0)
    return hashes[np.lexsort((hashes, counts))[:length]]


def _hints(docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(key, n): prefix shingles in hash order that are frequent within a piece of a task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            offsets, hashes = shingle_sets(text_array(piece.column("text")), width)
            prefixes = [hashes[a : a + prefix_length(b - a, threshold)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            seen, often = np.unique(np.concatenate(prefixes), return_counts=True)
            keep = often >= HOT_IN_PIECE
            yield pa.RecordBatch.from_arrays([pa.array(seen[keep].view(np.int64)), pa.array(often[keep], pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(build, "key bigint, n bigint")


def _sets(docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """One row per text: its set and its prefix, in the order with frequent shingles last."""
    hints = _hints(docs, width, threshold).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_COUNT)
    table = hints.orderBy(F.desc("n"), "key").limit(HOT_SHINGLES).toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = docs.sparkSession.sparkContext.broadcast((keys[order], table["n"].to_numpy()[order]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = np.uint64(0x9FB21C651E98DF25)
        for piece in pieces(batches, "text"):
            offsets, hashes = shingle_sets(text_array(piece.column("text")), width)
            sets = [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sketches = [odd_sketch(s) for s in sets]
            columns = [
                piece.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(offsets)),
                pa.array([int(np.add.reduce(s).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                pa.array([int(np.bitwise_xor.reduce(s * seed).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.array([halved(s) for s in sketches], pa.binary()),
                pa.array([_prefix(s, *hot.value, threshold).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "short", "prefix"])

    return written(docs.mapInArrow(build, _SET), "sets")


def _arrays(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The sorted hashes of the named texts, and of a few others that the filter lets pass."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            offsets, hashes = shingle_sets(text_array(piece.column("text")), width)
            blobs = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "hashes"])

    return may_be_in(docs, ids).mapInArrow(build, "doc_id bigint, hashes binary")


def _bounded(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave room for the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "n_a", "sketch_b", "n_b")))
            yield batch.select(["a", "b"]).filter(pa.array([may_reach(*row, threshold) for row in rows], pa.bool_()))

    above, below = threshold
    side = sets.select("doc_id", "n_shingles", "sketch")
    # Sizes come first: only pairs that they let pass carry a sketch through a shuffle.
    sized = pairs.join(sets.select("doc_id", "n_shingles").toDF("a", "_size"), "a")
    with_b = sized.join(side.toDF("b", "n_b", "sketch_b"), "b")
    with_b = with_b.filter(below * F.least("_size", "n_b") >= above * F.greatest("_size", "n_b")).drop("_size")
    both = with_b.join(side.toDF("a", "n_a", "sketch_a"), "a")
    return both.mapInArrow(keep, "a bigint, b bigint")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that reach the threshold, with the size of their intersection."""
    above, below = threshold
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    arrays = written(_arrays(docs, ids, width), "arrays")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, keep = [], []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                shared.append(both)
                keep.append(below * both >= above * (len(x) + len(y) - both))
            columns = [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))
        give_back_memory()

    joined = pairs.join(arrays.toDF("a", "hashes_a"), "a").join(arrays.toDF("b", "hashes_b"), "b")
    return written(joined.mapInArrow(compare, "a bigint, b bigint, shared bigint"), "verified")


def _tiles(members: DataFrame) -> DataFrame:
    """(shingle, doc_id, texts, pivots): tiles of at least two texts, from (doc_id, shingle).

    Tiles of the same texts give the same pairs, so only the one with the smallest shingle stays; that
    texts are the same is told by 128 bits. It keeps the smallest and the largest pivot of them all.
    """
    # The counts and the join read the same shuffle, as most shingles are those of one text and would not shrink before it.
    spread = members.filter("doc_id is not null and shingle is not null").repartition("shingle")
    # doc_id xor shingle orders the texts of each tile in another way, so pivots differ.
    found = spread.groupBy("shingle").agg(
        F.count("*").alias("texts"), F.bit_xor(F.xxhash64(F.lit(0), "doc_id")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("_y"), F.min(F.expr("doc_id ^ shingle")).alias("_pivot"),
    )
    found = found.filter("texts > 1").withColumn("_pivot", F.expr("_pivot ^ shingle"))
    kept = found.groupBy("texts", "_x", "_y").agg(
        F.min("shingle").alias("shingle"), F.array_distinct(F.array(F.min("_pivot"), F.max("_pivot"))).alias("pivots")
    )
    return spread.join(kept.select("shingle", "texts", "pivots"), "shingle")


def _grown(tree: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Of each tree among ``others`` its first, but for the tree of ``one``, which all of them become part of."""
    trees, first = np.unique(tree[others], return_index=True)
    first = first[trees != tree[one]]
    tree[np.isin(tree, trees)] = tree[one]
    return others[first]


def _cells(
    tiles: DataFrame, sets: DataFrame, threshold: tuple[int, int], cell: int = CELL_TEXTS, nearest: bool = False,
    spanning: bool = False,
) -> DataFrame:
    """Pairs of different components within a tile that size bands and sketches let pass.

    With ``nearest``, of these only one per text and cell: the one whose sketch differs least.
    With ``spanning``, only so many per cell that they connect the texts which all of them connect.
    """
    above, below = threshold
    rows = tiles.join(sets.select("doc_id", "n_shingles", "sketch"), "doc_id")
    rows = rows.withColumn("_parts", F.ceil(F.col("texts") / cell).cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.select(
        "shingle", F.least("_part", "_other").alias("low"), F.greatest("_part", "_other").alias("high"),
        F.col("_part").alias("part"), "doc_id", "n_shingles", "component_id", "sketch",
    )
    rows = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "doc_id")

    def within(rows: list[dict]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        size, group, part, ids = (np.array([r[c] for r in rows]) for c in ("n_shingles", "component_id", "part", "doc_id"))
        split = rows[0]["low"] != rows[0]["high"]
        # Sketches by length; similar texts differ by one step at most, the longer one is folded.
        lengths = np.array([len(r["sketch"]) for r in rows])
        places = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
        folded = {(n, n): np.array([np.frombuffer(rows[i]["sketch"], np.uint64) for i in at]) for n, at in places.items()}
        folded |= {(n, n // 2): m[:, : n // 16] ^ m[:, n // 16 :] for (n, _), m in list(folded.items()) if n > 8}
        spot = np.empty(len(rows), np.int64)
        for at in places.values():
            spot[at] = np.arange(len(at))
        tree = np.arange(len(rows))
        for k in range(len(rows)):
            own, best = int(lengths[k]), None
            for length, shared in ((own, own), (2 * own, own), (own // 2, own // 2)):
                if length not in places or (own, shared) not in folded:
                    continue
                at = places[length]
                fits = (group[at] != group[k]) & (below * np.minimum(size[k], size[at]) >= above * np.maximum(size[k], size[at]))
                if not nearest:
                    fits &= at > k
                if split:
                    fits &= part[at] != part[k]
                if spanning:
                    fits &= tree[at] != tree[k]
                fits = np.flatnonzero(fits)
                if len(fits):
                    apart = np.bitwise_count(folded[length, shared][fits] ^ folded[own, shared][spot[k]]).sum(axis=1).astype(np.int64)
                    both = size[k] + size[at[fits]]
                    passed = below * (both - apart) >= above * (both + apart)
                    if nearest:
                        share = np.where(passed, apart / both, 2.0)
                        least = int(np.argmin(share))
                        if passed[least] and (best is None or share[least] < best[0]):
                            best = (share[least], int(at[fits[least]]))
                        continue
                    others = at[fits[passed]]
                    for j in (_grown(tree, k, others) if spanning else others).tolist():
                        yield int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))
            if best is not None:
                yield int(min(ids[k], ids[best[1]])), int(max(ids[k], ids[best[1]]))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], set()
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["shingle"], row["low"], row["high"])
                if now != key:
                    found.update(within(held))
                    key, held = now, []
                held.append(row)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found))), ["a", "b"])
                found = set()
        found.update(within(held))
        if found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found))), ["a", "b"])

    return rows.mapInArrow(pair, "a bigint, b bigint").distinct()


def _open_tiles(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """The tiles that hold texts of several components; tiles of two texts are compared already."""
    rows = tiles.filter("texts > 2").join(groups, "doc_id", "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    several = rows.groupBy("shingle").agg(F.min("component_id").alias("l"), F.max("component_id").alias("h")).filter("l <> h")
    return rows.join(several.select("shingle"), "shingle", "left_semi")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: components that these connect become one."""
    ends = links.select("a", "b")
    for side in ("a", "b"):
        own = groups.select(F.col("doc_id").alias(side), "component_id")
        ends = ends.join(own, side, "left").withColumn(side, F.coalesce("component_id", side)).drop("component_id")
    merged = written(components(ends), "components").select(F.col("id").alias("component_id"), F.col("component_id").alias("_low"))
    single = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(groups, "doc_id", "left_anti")
    rows = groups.unionByName(single.withColumn("component_id", F.col("doc_id"))).join(merged, "component_id", "left")
    return written(rows.select("doc_id", F.coalesce("_low", "component_id").alias("component_id")), "components")


def _linked(sets: list[np.ndarray], side: np.ndarray | None, threshold: tuple[int, int]) -> np.ndarray:
    """Whether each set reaches the threshold with each other set (with sides, with those of the other side)."""
    above, below = threshold
    sizes = np.array([len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often > 1
    keep = several[code]
    row, column = np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(several) - 1)[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    columns = int(several.sum())
    for begin in range(0, columns, LINK_COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + LINK_COLUMNS])
        holds = np.zeros((len(sets), min(LINK_COLUMNS, columns - begin)), np.float32)
        holds[row[a:b], column[a:b] - begin] = 1
        both += (holds @ holds.T).astype(np.int64)
    link = below * both >= above * (sizes[:, None] + sizes - both)
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side
    return link


def _by_cell(docs: DataFrame, members: DataFrame, own: str, compare, schema: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The rows that ``compare`` makes of each bounded cell, from its class ids, sides, values of ``own`` and sets.

    ``members`` has class_id, component_id, n_shingles and ``own``, a bigint. All pairs of classes of a
    component whose sizes fit meet in one cell: in bands of sizes, of which a link joins at most neighbours.
    """
    above, below = threshold
    weight = F.sum("n_shingles") * 8
    whole = members.groupBy("component_id").agg(F.count("*").alias("_m"), weight.alias("_bytes")).filter("_m > 1")
    whole = whole.select("component_id", ((F.col("_m") <= LINK_TEXTS) & (F.col("_bytes") <= LINK_BYTES)).alias("_small"))
    # A little wider than the threshold, so that rounding puts no link beyond the next band.
    step = math.log(below / above) * (1 + 1e-9) if above < below else 1.0
    band = F.floor(F.log("n_shingles") / step) if above < below else F.col("n_shingles")
    rows = members.join(whole, "component_id").withColumn("band", F.when(F.col("_small"), F.lit(0)).otherwise(band).cast("bigint"))
    rows = written(rows.drop("_small"), "members")
    parts = rows.groupBy("component_id", "band").agg(
        F.ceil(F.greatest(F.count("*") / LINK_TEXTS, weight / LINK_BYTES)).cast("int").alias("parts")
    )
    key = ["component_id", "band"]
    up = parts.select("component_id", (F.col("band") - 1).alias("band"), F.col("parts").alias("up"))
    down = parts.select("component_id", (F.col("band") + 1).alias("band"), F.col("parts").alias("down"))
    rows = rows.join(parts, key).join(up, key, "left").join(down, key, "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))

    def cells(count: str, name) -> F.Column:
        none = F.array().cast("array<struct<first: bigint, across: boolean, low: int, high: int, side: int>>")
        return F.when(F.col(count).isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col(count) - 1), name))

    def cell(first, across, low, high, side):
        return F.struct(
            first.alias("first"), F.lit(across).alias("across"), low.cast("int").alias("low"), high.cast("int").alias("high"),
            side.cast("int").alias("side"),
        )

    band, part = F.col("band"), F.col("part")
    in_cells = F.concat(
        cells("parts", lambda q: cell(band, False, F.least(part, q), F.greatest(part, q), part)),
        cells("up", lambda q: cell(band, True, part, q, F.lit(0))),
        cells("down", lambda q: cell(band - 1, True, q, part, F.lit(1))),
    )
    arrays = _arrays(docs, rows.select(F.col("class_id").alias("doc_id")), width).withColumnRenamed("doc_id", "class_id")
    rows = rows.select("class_id", "component_id", own, in_cells.alias("_cells")).join(arrays, "class_id")
    rows = rows.select("class_id", "component_id", own, "hashes", F.explode("_cells").alias("_cell")).select(
        "component_id", "_cell.*", "class_id", own, "hashes"
    )
    place = ["component_id", "first", "across", "low", "high"]
    rows = rows.repartition(*place).sortWithinPartitions(*place)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, sides, owns, sets = zip(*held)
                side = np.array(sides) if key[2] or key[3] != key[4] else None
                yield compare(np.array(ids, np.int64), side, np.array(owns, np.int64), list(sets))

        key, held = None, []
        for batch in batches:
            hashes = batch.column("hashes")
            for at, row in enumerate(batch.drop_columns(["hashes"]).to_pylist()):
                now = tuple(row[p] for p in place)
                if now != key:
                    yield from settled()
                    key, held = now, []
                held.append((row["class_id"], row["side"], row[own], np.frombuffer(hashes[at].as_buffer(), np.uint64)))
        yield from settled()
        give_back_memory()

    return rows.mapInArrow(each, schema)


def _link_counts(docs: DataFrame, members: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(class_id, n_links): the texts of other classes that a class is linked with.

    ``members`` has class_id, component_id, n_shingles and copies; linked texts lie in one component.
    """

    def count(ids: np.ndarray, side: np.ndarray | None, copies: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        counted = _linked(sets, side, threshold).astype(np.int64) @ copies
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counted)], ["class_id", "links"])

    counts = _by_cell(docs, members, "copies", count, "class_id bigint, links bigint", width, threshold)
    return counts.groupBy("class_id").agg(F.sum("links").alias("n_links"))


def _cluster_links(
    docs: DataFrame, trees: DataFrame, sets: DataFrame, groups: DataFrame, width: int, threshold: tuple[int, int]
) -> DataFrame:
    """Links (a, b) that connect the components which all links within clusters connect.

    ``trees`` are pairs (a, b); the texts that they connect are a cluster.
    """

    def connect(ids: np.ndarray, side: np.ndarray | None, group: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        found = []
        if (group != group[0]).any():
            tree = group.copy()
            for k, link in enumerate(_linked(sets, side, threshold)):
                found += [(ids[k], ids[j]) for j in _grown(tree, k, np.flatnonzero(link & (tree != tree[k])))]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    clusters = written(components(trees), "clusters").withColumnRenamed("id", "class_id")
    members = clusters.join(sets.select(F.col("doc_id").alias("class_id"), "n_shingles"), "class_id")
    own = groups.select(F.col("doc_id").alias("class_id"), F.col("component_id").alias("group"))
    members = members.join(own, "class_id", "left").withColumn("group", F.coalesce("group", "class_id"))
    return written(_by_cell(docs, members, "group", connect, "a bigint, b bigint", width, threshold), "links")


def ngram_groups(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), with_links: bool = True) -> DataFrame:
    """One row per text: doc_id, n_shingles, n_links, component_id.

    ``docs`` has doc_id (unique; a row with a null one is linked with nothing) and text; other columns are not read.
    n_links counts the other texts that reach the threshold with the text, texts of the same set
    too; without ``with_links`` the column is left out, and links are not counted. A null or empty
    text, or one of white space only, has no shingles and is its own group. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = _sets(docs, width, threshold)
    # n_shingles in the key keeps texts without shingles apart from all others.
    classes = sets.filter("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count("doc_id").alias("copies"))
    classes = written(classes, "classes")
    # One text of each class stays: the others are named, as they are fewer, and do not move the rest.
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set_a", "set_b"]
    copies = full.select("doc_id", *key).join(classes.select("class_id", *key), key).filter("doc_id <> class_id").select("doc_id")
    kept = without(full.select("doc_id", "prefix"), written(copies, "copies"))
    tiles = written(_tiles(kept.select("doc_id", F.explode("prefix").alias("shingle"))), "tiles")

    pairs = tiles.select("doc_id", F.explode("pivots").alias("pivot")).filter("doc_id <> pivot")
    pairs = pairs.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"))
    pairs = written(_bounded(pairs.distinct(), sets, threshold), "pairs")
    links = _verified(docs, pairs, width, threshold)
    groups = written(components(links).withColumnRenamed("id", "doc_id"), "components")

    # A text goes to all its tiles, with the halved sketch: its bound is looser, and holds as well.
    short = sets.select("doc_id", "n_shingles", F.col("short").alias("sketch"))
    # In large tiles each text first meets its nearest one of another component only.
    large = _open_tiles(tiles.filter(F.col("texts") > LARGE_TILE), groups)
    more = written(_cells(large, short, threshold, nearest=True), "pairs")
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = _verified(docs, more, width, threshold)
    groups = _joined(groups, found)

    left = written(_cells(_open_tiles(tiles, groups), short, threshold, spanning=True), "trees")
    if not left.isEmpty():
        found = _cluster_links(docs, left, sets, groups, width, threshold)
        groups = _joined(groups, found)

    groups = groups.withColumnRenamed("doc_id", "class_id")
    of_class = classes.join(groups, "class_id", "left")
    if with_links:
        members = classes.join(groups, "class_id").select("class_id", "component_id", "n_shingles", "copies")
        of_class = of_class.join(_link_counts(docs, members, width, threshold), "class_id", "left")
    else:
        of_class = of_class.withColumn("n_links", F.lit(0))
    of_class = of_class.select(
        "n_shingles", "set_a", "set_b", F.coalesce("component_id", "class_id").alias("_component"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
    )
    n_links = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("_links", F.lit(0))).cast("bigint").alias("n_links")
    out = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["n_shingles", "set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", n_links, F.coalesce("_component", "doc_id").alias("component_id")
    )
    return out if with_links else out.drop("n_links")
