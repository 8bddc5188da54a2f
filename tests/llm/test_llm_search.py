"""Ranked search against scores of all documents, and what limits accumulators."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import ranked_search as R


def terms(text):
    return R.TERM.findall((text or "").translate(R._TO_LOWER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 25 + ((25 * sum(c.values()) * n) // length)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "é", "ñandú", "ΑΒ"]
    docs = [(i, rng.choice((" ", "-", "\n", "\x00", "__")).join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 300))) for i in range(n)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, None), (n, ""), (n + 1, None), (n + 2, " .,;"), (n + 3, "x" * 200_000 + " w1 W1 w2")]
    docs += [(n + 10 + i, docs[3][1]) for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(12)] + [(3, "w1"), (50, None), (51, "nowhere"), (52, "W1 w1, w1")]
    return docs, items


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(parts)
    return d, spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize(("seed", "k"), [(0, 20), (1, 3), (2, 1)])
def test_equals_brute_force(spark, seed, k, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(R, "ITEMS_BYTES", 600)
    docs, items = corpus(seed)
    rows = R.ranked_search(*frames(spark, docs, items), k=k).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(docs, items, k)


def test_no_documents_or_items(spark):
    d, i = frames(spark, [(1, "a b")], [(1, "a")])
    empty, none = frames(spark, [(1, None)], [(1, None)])
    assert R.ranked_search(empty, i).collect() == []
    assert R.ranked_search(d, none).collect() == []
    assert R.ranked_search(d.limit(0), i.limit(0)).collect() == []
    assert [tuple(r) for r in R.ranked_search(d, i).collect()] == brute([(1, "a b")], [(1, "a")], 20)


def test_accumulators_are_limited():
    """Common terms make no accumulators once a known score is out of their reach, and scores stay exact."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"c{i}" for i in range(8)], k=30)) + (f" rare{i % 40}" if i % 10 == 0 else "") for i in range(2000)]
    row = R.index_block(pa.array(range(2000)), pa.array(texts))
    counted = Counter(terms("rare0 c0 c1"))
    df = Counter(t for text in texts for t in set(terms(text)))
    names = sorted(counted)
    number = {t: i for i, t in enumerate(names)}
    item = R.Item(counted, number, [df[t] for t in names], 2000)
    block = R.Block(row, pa.array(names), 2000, row["n_terms"])
    everything = R.rank_block(block, item, 2000, 0)
    assert len(everything[0]) > 1900
    found, scores = R.rank_block(block, item, 5, 0)
    assert len(found) < 60
    order = np.lexsort((everything[0], -everything[1]))[:5]
    mine = np.lexsort((found, -scores))[:5]
    assert list(found[mine]) == list(everything[0][order]) and list(scores[mine]) == list(everything[1][order])


def test_packing():
    for values in ([], [0], [255], [256, 1], [1 << 20], [1 << 40]):
        assert list(R.unpack(R.pack(np.array(values, np.int64)))) == values
