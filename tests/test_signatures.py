"""Substring search behind trigram signatures against a search of all texts."""

import random

import pytest

from shelfmark.plans import search as S
from shelfmark.plans import signatures as G

SCHEMA = "dataset_id string, content string"


def rows(n=1500):
    rng = random.Random(3)
    words = ["data", "text", "übung", "日本語の", "😀😀x", "a-b", "%_", "tail"]
    out = [(f"d{i:04}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    for at in (7, 8, 900):
        out[at] = (out[at][0], out[at][1] + " quizzical")
    return [*out, ("none", None), ("empty", ""), ("two", "zq"), ("long", "ab" * 40_000 + "needle" + "cd" * 10)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def index(corpus):
    return G.build_signatures(corpus, block_bits=3)


@pytest.mark.parametrize(
    "query", ["quizzical", "QUIZZICAL data", "needle absent", "zq", "zq quizzical", "日本語の", "😀😀x", "%_ _%", "absentword", "", "izzica ataz", "ext a-b"]
)
def test_all_hits_are_kept(corpus, index, query):
    found = sorted(map(tuple, G.signed_matches(index, query).collect()))
    tokens = query.lower().split()
    wanted = [(d, sum(t in c for t in tokens)) for d, c in rows() if c is not None and any(t in c for t in tokens)]
    assert found == sorted(wanted)
    assert found == sorted(map(tuple, S.matches(corpus, query).collect()))


def test_few_blocks_are_read(index):
    read = G.blocks_read(index, "quizzical").first()
    assert read.blocks > 180 and 1 <= read.blocks_read <= 3
    assert G.blocks_read(index, "zq").first().blocks_read == read.blocks
    assert G.blocks_read(index, "absentword").first().blocks_read == 0
    plan = G.signed_matches(index, "quizzical")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block" in plan or "EqualTo(block" in plan


def test_pieces_of_a_text_overlap(spark, monkeypatch):
    text = "0123456789" * 3 + "xyz"
    whole = set(G.slots(text).tolist())
    parts = set()
    for start in range(0, len(text) - 2, 4):
        parts |= set(G.slots(text[start : start + 6]).tolist())
    assert parts == whole


def test_many_ranges_are_taken_together(index, monkeypatch):
    monkeypatch.setattr(G, "MOST_RANGES", 6)
    assert G.signed_matches(index, "data").count() == sum("data" in (c or "") for _, c in rows())
    monkeypatch.setattr(G, "MOST_RANGES", 1)
    assert G.signed_matches(index, "data").count() == sum("data" in (c or "") for _, c in rows())


def test_a_corpus_without_rows(spark):
    index = G.build_signatures(spark.createDataFrame([], SCHEMA))
    assert G.signed_matches(index, "data text").count() == 0
    assert tuple(G.blocks_read(index, "data").first()) == (0, 0)
