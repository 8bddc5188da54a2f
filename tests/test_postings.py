"""Dense numbers, and search over lists with block maxima against scores of all texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators.numbering import numbered
from shelfmark.plans import postings as P


def texts(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(500)] + ["über", "Éa", "x_1"]
    rows = [(f"d{i:04}", " ".join(rng.choices(words, k=int(rng.paretovariate(0.9)) % 200))) for i in range(n)]
    return [*rows, ("empty", ""), ("none", None), ("marks", " ., "), *[(f"same{i}", rows[5][1]) for i in range(12)]]


def brute(rows, queries, k):
    terms = lambda t: re.findall(r"\w+", (t or "").lower())
    counted = [(d, Counter(terms(t))) for d, t in rows]
    average = sum(sum(c.values()) for _, c in counted) / len(counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, text in queries:
        scored = []
        for d, c in counted:
            length = sum(c.values())
            parts = [
                math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / average)) for t in terms(text) if t in c
            ]
            if parts:
                scored.append((-round(sum(parts), 10), d))
        out += [(q, rank, d, round(-s, 6)) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rows = texts(1)
    rng = random.Random(2)
    some = [w for _, t in rows[:50] for w in (t or "").split()]
    queries = [(f"q{i}", " ".join(rng.choices(some, k=rng.randint(1, 8)))) for i in range(15)] + [("again", "w1 W1 w2"), ("nothing", "zzz"), ("blank", "")]
    return rows, queries


@pytest.mark.parametrize(("block_docs", "k"), [(16, 10), (4096, 3), (1, 1)])
def test_search_equals_brute_force(spark, corpus, block_docs, k):
    rows, queries = corpus
    index = P.build_postings(spark.createDataFrame(rows, "dataset_id string, content string").repartition(5), block_docs, buckets=4)
    hits = P.search_postings(index, spark.createDataFrame(queries, "query_id string, query string"), k).collect()
    assert sorted((h.query_id, h.rank, h.dataset_id, round(h.score, 6)) for h in hits) == brute(rows, queries, k)


def test_ranges_are_skipped_and_only_files_of_terms_read(spark):
    rows = [(f"d{i:05}", "common " * (1 + i % 3) + ("rare " * 3 if i in (700, 701, 1500) else "")) for i in range(2000)]
    index = P.build_postings(spark.createDataFrame(rows, "dataset_id string, content string").coalesce(1), 50, buckets=16)
    asked = spark.createDataFrame([("q", "rare common")], "query_id string, query string")
    weights = P._weights(index, asked)
    bounds, _, further = P.choose_ranges(index, weights, 2)
    assert bounds.count() == 40 and further.count() == 0
    assert [h.dataset_id for h in P.search_postings(index, asked, 2).collect()] == ["d01500", "d00700"]
    lists = index.lists.filter(F.col("bucket") == P._bucket(F.lit("rare"), 16)).filter("term = 'rare'")
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in plan
    assert {f.rsplit("/", 2)[1] for f in lists.inputFiles()} >= {r["b"] for r in lists.select(F.concat(F.lit("bucket="), "bucket").alias("b")).distinct().collect()}


def test_empty_corpus(spark):
    index = P.build_postings(spark.createDataFrame([], "dataset_id string, content string"), 4, buckets=2)
    assert P.search_postings(index, spark.createDataFrame([("q", "a")], "query_id string, query string"), 3).collect() == []


def test_term_counts(spark):
    df = spark.createDataFrame([("b a B c_1 a b",), ("",), (None,), ("é É 1",)], "t string")
    got = [{c.term: c.tf for c in r.c or []} for r in df.select(P.term_counts("t").alias("c")).collect()]
    assert got == [dict(Counter(r.t)) for r in df.select(X.terms("t").alias("t")).collect()]


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_dense_and_stay(spark, parts):
    rows = numbered(spark.range(1000).repartition(parts).filter("id % 3 > 0"), "no")
    first = {r.id: r.no for r in rows.collect()}
    assert sorted(first.values()) == list(range(666)) and first == {r.id: r.no for r in rows.collect()}
    assert numbered(spark.range(0)).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    with pytest.raises(ValueError):
        numbered(rows, "no")


def test_numbers_follow_a_sort(spark):
    rows = spark.range(500).selectExpr("id", "id * 7919 % 500 as key").repartition(6).orderBy("key")
    assert all(r.no == r.key for r in numbered(rows, "no").collect())


def test_only_the_best_of_a_range_leave_its_task(spark):
    """All scores of all queries are more than the index."""
    rows = [(f"d{i:05}", "common " * (1 + i % 7) + f"own{i} " * (i % 5)) for i in range(2000)]
    index = P.build_postings(spark.createDataFrame(rows, "dataset_id string, content string").repartition(3), 50, buckets=4)
    asked = spark.createDataFrame([("q", "common"), ("r", "common common own77")], "query_id string, query string")
    _, scored, _ = P.choose_ranges(index, P._weights(index, asked), 2, first_ranges=100)
    by_query = {q: sorted((h.score for h in scored.filter(F.col("query_id") == q).collect()), reverse=True) for q in "qr"}
    # Equal scores of the last stay, and 2,000 texts have but 35 scores.
    assert all(2 <= len(s) < 500 for s in by_query.values())
    best = brute(rows, [("q", "common"), ("r", "common common own77")], 2)
    assert sorted((q, round(s, 6)) for q, scores in by_query.items() for s in scores[:2]) == sorted((q, s) for q, _, _, s in best)


@pytest.mark.parametrize(("most_terms", "block_parts", "broadcast"), [(60, 7, 0), (1 << 20, 1 << 20, 100_000)])
def test_lists_equal_counts_of_the_texts(spark, corpus, monkeypatch, most_terms, block_parts, broadcast):
    """Long texts end a range early; parts, blocks of queries and weights are bounded without a change to the hits."""
    monkeypatch.setattr(P, "RANGE_TERMS", most_terms)
    monkeypatch.setattr(P, "BLOCK_PARTS", block_parts)
    monkeypatch.setattr(P, "BROADCAST_WEIGHTS", broadcast)
    monkeypatch.setattr(P, "SPAN_QUERIES", 4)
    rows, queries = corpus
    rows = [*rows, ("again", "w1 w1 w9"), ("again", "w1 w1 w9"), (None, "w2 w9")]
    index = P.build_postings(spark.createDataFrame(rows, "dataset_id string, content string").repartition(3), 16, buckets=4)
    texts = {r.doc_no: r for r in index.documents.collect()}
    assert len(texts) == len(rows) and sorted(r.dataset_id or "" for r in texts.values()) == sorted(d or "" for d, _ in rows)
    held = index.lists.collect()
    assert len({(r.term, r.range) for r in held}) == len(held) and all(r.n == len(r.offsets) <= 16 for r in held)
    got = Counter()
    for r in held:
        for offset, tf, length in zip(r.offsets, r.tfs, r.lens):
            assert texts[r.range * 16 + offset].doc_len == length
            got[r.term, texts[r.range * 16 + offset].dataset_id, tf] += 1
    counted = [(d, Counter(re.findall(r"\w+", (t or "").lower()))) for d, t in rows]
    assert got == Counter((term, d, tf) for d, c in counted for term, tf in c.items())
    assert {r.term: r.df for r in index.terms.collect()} == Counter(t for _, c in counted for t in c)
    asked = spark.createDataFrame(queries, "query_id string, query string")
    hits = [(h.query_id, h.rank, h.dataset_id or "", round(h.score, 6)) for h in P.search_postings(index, asked, 5).collect()]
    assert sorted(hits) == brute([(d or "", t) for d, t in rows], queries, 5)
