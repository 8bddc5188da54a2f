"""Joins on pairs and exact groups against brute force, with the odd cases of the docstrings."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import ngram_join as N
from shelfmark.llm.components import components
from shelfmark.llm.exact_dedup import exact_groups, rice_decode, rice_encode
from shelfmark.llm import id_filter as I
from shelfmark.llm.id_filter import may_be_in, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, shingle string, sketch string, component_id string, print string, owner int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, "y", "z", 3) for d, t in rows], SCHEMA).repartition(3)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def grouped(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return sorted((d, len(sets[d]), top(d)) for d in ids)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    passage = [rng.choice(words) for _ in range(60)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c d e f", "É é É é É", "é é é é é"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and len(out) > 12:
            base = list(filter(None, rng.choice(out[11:]).split()))
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(rng.choice((" ", "\n", "  ")).join(base))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 5, 9, 40, 200)))) + rng.choice(("", " " + " ".join(passage))))
    return list(enumerate(out, start=5))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "HOT_COUNT", 4)
    rows = texts(seed, 120)
    got = N.ngram_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "n_links", "component_id"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == grouped(rows)


@pytest.mark.parametrize("cell", [3, 512])
def test_links_equal_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(N, "LINK_TEXTS", cell)
    monkeypatch.setattr(N, "LINK_COLUMNS", 7 * cell)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(90)]
    rows = texts(3, 40)
    for k in range(40):  # one group: near copies, exact ones, and longer ones
        own = base + [f"t{i}" for i in range(rng.randint(0, 25))]
        own[rng.randrange(90)] = f"z{k % 30}"
        rows += [(1000 + 2 * k, " ".join(own)), (1001 + 2 * k, " ".join(own if k % 3 else base))]
    sets = {d: shingles(t) for d, t in rows}
    want = {d: sum(100 * len(x & y) >= 80 * len(x | y) for e, y in sets.items() if e != d and x and y) for d, x in sets.items()}
    got = N.ngram_groups(frame(spark, [*rows, (None, " ".join(base))]))
    assert {r.doc_id: r.n_links for r in got.collect()} == {**want, None: 0}
    assert N.ngram_groups(frame(spark, rows), with_links=False).columns == ["doc_id", "n_shingles", "component_id"]


def test_chain_of_links_and_long_text(spark):
    words = [f"x{i}" for i in range(3000)]
    rows = [(k + 1, " ".join(words[k * 60 : k * 60 + 800])) for k in range(8)] + [(50, " ".join(words * 20))]
    got = {r.doc_id: r.component_id for r in N.ngram_groups(frame(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == [c for _, _, c in grouped(rows)] and got[8] == 1


def test_groups_of_empty_table_and_null_id(spark):
    assert N.ngram_groups(frame(spark, [])).count() == 0
    got = N.ngram_groups(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted(r.component_id for r in got if r.doc_id) == [1, 1]


def test_prefix_and_sketch_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([base[int(rng.integers(0, n)) :], rng.integers(0, 1 << 62, 5).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert N.differing(N.odd_sketch(a), N.odd_sketch(b)) <= len(a) + len(b) - 2 * both
        if 100 * both >= 80 * (len(a) + len(b) - both):
            first = [set(x[: N.prefix_length(len(x), (80, 100))].tolist()) for x in (a, b)]
            assert first[0] & first[1]
            assert N.may_reach(N.odd_sketch(a), len(a), N.odd_sketch(b), len(b), (80, 100))


@pytest.mark.parametrize("cell", [1000, 7])
def test_cells_find_what_the_pairwise_bound_lets_pass(spark, cell):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    rows, sketches = [], []
    for doc in range(60):
        x = np.unique(np.concatenate([base[: int(rng.integers(1, 400))], rng.integers(0, 1 << 62, 9).astype(np.uint64)]))
        rows.append((7, doc, len(x), int(rng.integers(0, 40)), 60))
        sketches.append((doc, N.odd_sketch(x), len(x)))
    expected = {
        (a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :]
        if a[3] != b[3] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])
        and N.may_reach(sketches[a[1]][1], a[2], sketches[b[1]][1], b[2], (80, 100))
    }
    tiles = spark.createDataFrame(rows, "shingle long, doc_id long, n_shingles long, component_id long, texts long")
    sets = spark.createDataFrame(sketches, "doc_id long, sketch binary, n_shingles long")
    got = N._cells(tiles.drop("n_shingles"), sets, (80, 100), cell)
    assert {tuple(r) for r in got.collect()} == expected and expected


@pytest.mark.parametrize("cell", [3, 512])
def test_near_misses_leave_cells_as_trees(spark, cell, monkeypatch):
    monkeypatch.setattr(N, "LINK_TEXTS", cell)
    base = [f"v{i}" for i in range(204)]  # 200 shingles; texts with 24 of their own miss the threshold, those with 20 reach it
    rows = [(d, " ".join([f"t{d}w{i}" for i in range(own)] + base[own:])) for d in range(60, 0, -1) for own in [20 if d % 7 == 3 else 24]]
    seen, cells = [], N._cells

    def counted(tiles, *args, **kind):
        found = cells(tiles, *args, **kind)
        seen.append((found.count(), tiles.count()))
        return found

    monkeypatch.setattr(N, "_cells", counted)
    got = N.ngram_groups(frame(spark, rows), with_links=False).collect()
    assert sorted(map(tuple, got)) == grouped(rows)
    assert len({r.component_id for r in got}) == 60 - 9 + 1
    assert seen[-1][0] and all(pairs <= texts for pairs, texts in seen)


def test_trees_connect_what_all_pairs_connect(spark):
    rng = random.Random(8)
    rows, sketches = [], []
    for doc in range(90):
        x = np.unique(np.array([hash((doc % 4, i)) % (1 << 62) for i in range(300)] + [rng.getrandbits(62) for _ in range(25)], np.uint64))
        sketches.append((doc, N.odd_sketch(x), len(x)))
        rows += [(shingle, doc, doc // 3, 90) for shingle in range(6)]
    tiles = spark.createDataFrame(rows, "shingle long, doc_id long, component_id long, texts long")
    sets = spark.createDataFrame(sketches, "doc_id long, sketch binary, n_shingles long")
    whole = N._cells(tiles, sets, (80, 100))
    for cell in (1000, 20):
        trees = N._cells(tiles, sets, (80, 100), cell, spanning=True)
        assert sorted(components(trees).collect()) == sorted(components(whole).collect())
    assert N._cells(tiles, sets, (80, 100), spanning=True).count() < 90 < whole.count()


def test_tiles_of_the_same_texts_are_one(spark):
    rng = random.Random(4)
    some = [rng.sample(range(30), rng.choice((1, 2, 2, 3, 9))) for _ in range(25)]
    tiles = {rng.getrandbits(63) - (1 << 62): frozenset(rng.choice(some)) for _ in range(300)}
    rows = [(doc, shingle) for shingle, texts in tiles.items() for doc in texts]
    got = N._tiles(spark.createDataFrame([*rows, (None, 5), (None, 6)], "doc_id long, shingle long").repartition(5)).collect()
    held = {}
    for r in got:
        assert r.texts == len(tiles[r.shingle]) and set(r.pivots) <= tiles[r.shingle] and 1 <= len(r.pivots) <= 2
        held.setdefault(r.shingle, []).append(r.doc_id)
    several = [(k, t) for k, t in tiles.items() if len(t) > 1]
    first = {t: min(k for k, u in several if u == t) for _, t in several}
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(t) for t, k in first.items()}


def test_bounds_carry_sketches_of_fitting_sizes_only(spark):
    sets = spark.createDataFrame([(d, n, bytes(8)) for d, n in ((1, 10), (2, 9), (3, 40))], "doc_id long, n_shingles long, sketch binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    found = N._bounded(pairs, sets, (80, 100))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    joins = [x for x in found._jdf.queryExecution().analyzed().toString().split("\n") if re.search(r"^[\s:+-]*(Join|Filter)", x)]
    assert "Join" in joins[0] and "Filter" in joins[1]  # a sketch of one side joins behind the filter of sizes


def test_halved_sketch_is_that_of_fewer_bits(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (3, 40, 700):
        hashes = rng.integers(0, 1 << 62, n).astype(np.uint64)
        half = N.halved(N.odd_sketch(hashes))
        monkeypatch.setattr(N, "SKETCH_SPREAD", 1)
        assert len(half) == max(8, len(N.odd_sketch(hashes))) and half == N.odd_sketch(hashes)
        monkeypatch.setattr(N, "SKETCH_SPREAD", 2)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50), (60, 61), (60, 62), (60, 63), (None, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31))
    assert (got[41], got[50], got[63]) == (40, 50, 60)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_rice_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    k, blob = rice_encode(values)
    assert (rice_decode(k, len(values), blob) == values).all()
    dense = np.arange(n, dtype=np.uint64)
    assert (rice_decode(*((c := rice_encode(dense))[0], n, c[1])) == dense).all()
    if n == 5000:
        assert len(blob) * 8 / n < 56


def test_exact_groups(spark):
    rows = texts(4, 40) + [(200 + i, "Same TEXT É") for i in range(30)] + [(300, "same text É"), (301, "same text é"), (302, "x" * 3_000_000)]
    whole = {d: (t or "").translate(LOWER) for d, t in rows}
    expected = sorted(
        (d, max(e for e in whole if whole[e] == w), sum(v == w for v in whole.values()), d == max(e for e in whole if whole[e] == w),
         hashlib.sha256(w.encode()).hexdigest()) for d, w in whole.items()
    )
    got = exact_groups(frame(spark, rows), owner_rows=20)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == expected
    assert exact_groups(frame(spark, [])).count() == 0
    nameless = exact_groups(frame(spark, [(None, "a"), (1, "A"), (None, "b"), (None, "b"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in nameless) == [
        ("1", "1", 2, True), ("None", "1", 2, False), ("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, True),
    ]


def test_id_filter(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    ids = spark.range(0, 5000, 7)
    inside = {r.doc_id for r in may_be_in(rows, ids).collect()}
    outside = {r.doc_id for r in may_be_in(rows, ids, inside=False).collect()}
    assert set(range(0, 5000, 7)) <= inside and inside | outside == set(range(5000)) and not inside & outside
    assert {r.doc_id for r in without(rows, ids).collect()} == set(range(5000)) - set(range(0, 5000, 7))
    assert without(rows, ids.limit(0)).count() == 5000 and may_be_in(rows, ids.limit(0)).count() == 0
    nameless = rows.selectExpr("nullif(doc_id, 3) as doc_id", "text", "text as part", "doc_id as bits")
    assert without(nameless, ids).count() == 5000 - 715 and without(nameless, ids).columns == nameless.columns
    plan = without(rows, ids)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_too_many_ids_for_a_filter(spark, monkeypatch):
    assert I.filter_bits(0) == I.LEAST_BITS and I.filter_bits(1 << 26) == I.MOST_BITS and I.filter_bits((1 << 26) + 1) is None
    monkeypatch.setattr(I, "MOST_BITS", 1)
    rows = spark.range(100).selectExpr("id as doc_id")
    assert may_be_in(rows, spark.range(5)).count() == 100 and may_be_in(rows, spark.range(5), inside=False).count() == 0
    assert without(rows, spark.range(5)).count() == 95
