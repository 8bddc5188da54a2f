import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogs import artifacts, column, datasets, frame
from shelfmark.operators.catalog import Filters, search_corpus
from shelfmark.plans import search as S


def run(spark, query, **options):
    table = datasets(spark)
    return S.search_tokens(search_corpus(table), table, artifacts(spark), query, **options).collect()


def test_best_hit_first_with_schema(spark):
    hits = run(spark, "text hourly")
    assert [h.id for h in hits] == ["sea/tides", "sea/charts", "sky/hail"]
    assert hits[0].has_schema and not hits[1].has_schema and not hits[2].has_schema
    assert hits[0].score == 2.0 and hits[0].why == ["text", "hourly"]
    assert (hits[0].downloads, hits[0].likes) == (12, 3) and hits[2].downloads is None


def test_repeated_tokens_count_twice(spark):
    hits = run(spark, "hail hail")
    assert [(h.id, h.score, h.why) for h in hits] == [("sky/hail", 2.0, ["hail", "hail"])]


def test_wildcards_are_plain_characters(spark):
    assert run(spark, "%") == [] and run(spark, "ha_l") == []


def test_empty_query_finds_nothing(spark):
    assert run(spark, " \n ") == []


def test_filters_paging_and_total(spark):
    assert [h.id for h in run(spark, "text hourly", filters=Filters(license_class="mit"))] == ["sea/tides"]
    assert [h.id for h in run(spark, "text hourly", limit=1, offset=1)] == ["sea/charts"]
    table = datasets(spark)
    assert S.search_total(search_corpus(table), table, "text hourly").first().total == 3
    with pytest.raises(ValueError):
        run(spark, "x", limit=101)


def test_a_snapshot_of_the_corpus_may_hold_removed_datasets(spark):
    table = datasets(spark)
    corpus = search_corpus(table)
    left = table.filter("id <> 'sea/tides'")
    assert "sea/tides" not in [h.id for h in S.search_tokens(corpus, left, artifacts(spark), "text").collect()]


def test_hits_with_sample_rows(spark):
    rows = frame(spark, "sample_rows", [{"row_id": "1", "dataset_id": "sky/hail"}, {"row_id": "2", "dataset_id": "sky/hail"}])
    hits = run(spark, "text hourly", sample_rows=rows)
    assert {h.id: h.has_sample_rows for h in hits} == {
        "sea/tides": False, "sea/charts": False, "sky/hail": True}


def random_corpus(spark, n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé,") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = {f"d{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(n)}
    queries = {f"q{i}": " ".join(rng.choice(words)[: rng.randrange(1, 9)] for _ in range(rng.randrange(1, 6))) for i in range(12)}
    corpus = spark.createDataFrame(list(texts.items()), "dataset_id string, content string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    return texts, queries, corpus, asked


def best(scores, k):
    """The k best (score descending, id ascending) per query out of {(query, id): score}."""
    found = {}
    for (q, d), score in sorted(scores.items(), key=lambda item: (item[0][0], -item[1], item[0][1])):
        found.setdefault(q, []).append((d, score))
    return {(q, rank): hit for q, hits in found.items() for rank, hit in enumerate(hits[:k], 1)}


@pytest.mark.parametrize("block_bytes,block_scores", [(8 << 20, 4_000_000), (60, 30)])
def test_batch_search_equals_brute_force(spark, monkeypatch, block_bytes, block_scores):
    monkeypatch.setattr(S, "QUERY_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(S, "BLOCK_SCORES", block_scores)
    texts, queries, corpus, asked = random_corpus(spark, 80, 4)
    scores = {(q, d): sum(t in text for t in query.lower().split()) for q, query in queries.items() for d, text in texts.items()}
    expected = best({pair: score for pair, score in scores.items() if score}, 7)
    blank = spark.createDataFrame([("blank", " \n"), ("none", None)], "query_id string, query string")
    got = S.search_tokens_batch(corpus.repartition(3), None, asked.union(blank), 7).collect()
    assert {(r.query_id, r.rank): (r.dataset_id, r.score) for r in got} == expected


def bm25(texts, query):
    split = {d: re.findall(r"\w+", t.lower()) for d, t in texts.items()}
    average = sum(map(len, split.values())) / len(split)
    scores = Counter()
    for term in re.findall(r"\w+", query.lower()):
        df = sum(term in words for words in split.values())
        idf = math.log(1 + (len(split) - df + 0.5) / (df + 0.5))
        for d, words in split.items():
            tf = words.count(term)
            if tf:
                scores[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
    return scores


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_bm25_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(S, "QUERY_BLOCK_BYTES", block_bytes)
    texts, queries, corpus, asked = random_corpus(spark, 60, 11)
    expected = {(q, d): s for q, query in queries.items() for d, s in bm25(texts, query).items()}
    for index in (S.build_term_index(corpus), S.build_term_index(corpus, asked)):
        assert index.documents.count() == 60
        for q, query in list(queries.items())[:3]:
            got = {r.dataset_id: r.score for r in S.bm25_scores(index, query).collect()}
            assert got == pytest.approx({d: s for (name, d), s in expected.items() if name == q})
        ranked = S.search_bm25_batch(index, None, asked, 5).collect()
        tops = best(expected, 5)
        assert {(r.query_id, r.rank) for r in ranked} == tops.keys()
        assert all(r.score == pytest.approx(tops[r.query_id, r.rank][1]) for r in ranked)
        assert all(r.score == pytest.approx(expected[r.query_id, r.dataset_id]) for r in ranked)


def test_bm25_falls_back_to_token_hits(spark):
    table = datasets(spark)
    corpus = search_corpus(table)
    index = S.build_term_index(corpus)
    assert S.search_bm25(index, table, artifacts(spark), "gaug moo").count() == 0
    hits = S.search_bm25(index, table, artifacts(spark), "gaug moo", fall_back=corpus)
    assert column(hits, "id")[0] == "sea/tides"
    by_term = S.search_bm25(index, table, artifacts(spark), "moon", fall_back=corpus)
    assert column(by_term, "id") == column(S.search_bm25(index, table, artifacts(spark), "moon"), "id")


def test_bm25_page(spark, tmp_path):
    table = datasets(spark)
    S.store_term_index(S.build_term_index(search_corpus(table)), str(tmp_path / "index"))
    index = S.load_term_index(spark, str(tmp_path / "index"))
    hits = S.search_bm25(index, table, artifacts(spark), "moon gauges", limit=5).collect()
    assert [h.id for h in hits] == ["sea/tides"] and hits[0].has_schema


def test_batch_top_k_is_restricted(spark):
    table = datasets(spark)
    asked = spark.createDataFrame([("q", "hourly over")], "query_id string, query string")
    got = S.search_tokens_batch(search_corpus(table), table, asked, 2, Filters(language="en"))
    assert [(r.rank, r.dataset_id) for r in got.orderBy("rank").collect()] == [(1, "sea/tides"), (2, "sea/charts")]
    own = S.search_tokens_batch(search_corpus(table, with_filters=True), None, asked, 2, Filters(language="en"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, got.collect()))
    none = S.search_tokens_batch(search_corpus(table), table, asked.filter(F.lit(False)), 2)
    assert none.count() == 0
    assert column(got, "query_id") == ["q", "q"]
