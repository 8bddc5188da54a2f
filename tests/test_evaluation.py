import math

import pytest
from pyspark.sql import functions as F

from catalogs import AS_OF, artifacts, column, datasets, frame
from shelfmark.operators import keyed as K
from shelfmark.operators.catalog import search_corpus
from shelfmark.plans import dense as D
from shelfmark.plans import evaluation as E
from shelfmark.plans.search import build_term_index
from shelfmark.sources.tables import write_report
from shelfmark.workload.dense import DigestEmbedder


def metrics_of(spark, flags, k, total):
    results = frame(spark, "eval_run_results", [
        {"run_id": "r", "query_id": "q", "result_rank": i, "dataset_id": f"d{i}"} for i, _ in enumerate(flags, 1)])
    judged = frame(spark, "eval_judgments", [
        {"query_id": "q", "dataset_id": f"d{i}", "relevant": f} for i, f in enumerate(flags, 1) if f is not None])
    queries = frame(spark, "eval_queries", [{"id": "q", "label": "L", "query": "x", "total_relevant": total, "active": True}])
    runs = frame(spark, "eval_runs", [{"id": "r", "label": "run", "engine": "bm25", "k": k, "created_at": AS_OF}])
    return results, judged, queries, runs


@pytest.mark.parametrize("flags, k, total, expected", [
    ([False] * 10, 10, 1, dict(precision=0, recall=0, f1=0, mrr=0, ap=0, ndcg=0)),
    ([True] + [False] * 9, 10, 1, dict(precision=0.1, recall=1, mrr=1, ap=1, ndcg=1)),
    ([False, False, True] + [False] * 7, 10, 1, dict(precision=0.1, recall=1, mrr=1 / 3, ap=1 / 3, ndcg=0.5)),
    ([True, True, False, False, False], 5, 2, dict(precision=0.4, recall=1, f1=4 / 7)),
    ([None, True, None], 3, 1, dict(mrr=0.5)),
    ([True, False, True], 3, 4, dict(ap=(1 + 2 / 3) / 4, ndcg=1.5 / (1 + 1 / math.log2(3) + 0.5))),
    ([True], 10, 0, dict(recall=1)),
    ([True], 10, -1, dict(precision=0, recall=0, ndcg=0)),
])
def test_metrics(spark, flags, k, total, expected):
    row = E.query_metrics(*metrics_of(spark, flags, k, total)).first()
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


def test_query_without_hits(spark):
    results, judged, queries, runs = metrics_of(spark, [True], 10, 1)
    more = queries.unionByName(frame(spark, "eval_queries", [{"id": "empty", "query": "y", "active": True}]))
    assert column(E.query_metrics(results, judged, more, runs), "query_id") == ["q"]
    whole = E.query_metrics(results, judged, more, runs, E.asked_queries("r", more))
    assert {r.query_id: r.ap for r in whole.collect()} == {"q": 1.0, "empty": 0.0}
    assert E.run_summaries(runs, whole).first().map == 0.5


def test_deleted_query_has_defaults(spark):
    results, judged, queries, runs = metrics_of(spark, [True], 10, 3)
    row = E.query_metrics(results, judged, queries.filter(F.lit(False)), runs).first()
    assert (row.label, row["query"], row.total_relevant, row.recall) == ("", "", 1, 1.0)


def test_history_newest_first_and_runs_without_results(spark):
    results, judged, queries, runs = metrics_of(spark, [True], 10, 1)
    runs = runs.unionByName(frame(spark, "eval_runs", [{"id": "s", "k": 5, "created_at": "2024-02-02 00:00:00"}]))
    history = E.run_summaries(runs, E.query_metrics(results, judged, queries, runs)).collect()
    assert [(r.id, r.map) for r in history] == [("s", 0.0), ("r", 1.0)]
    assert column(E.list_runs(runs), "id") == ["s", "r"]


def test_report(spark, tmp_path):
    data = metrics_of(spark, [True, None, False], 10, 1)
    sheet = E.query_sheet(*data[:3]).orderBy("rank").collect()
    assert [(r.judged, r.rel, r.cum, r.idcg_term) for r in sheet] == [("yes", 1, 1, 1.0), ("", 0, 1, 0.0), ("no", 0, 1, 0.0)]
    summary = E.summary_with_mean(E.query_metrics(*data))
    assert {r.query_id: (r.label, r.ap) for r in summary.collect()} == {
        "q": ("L", 1.0), "MEAN": ("mean of all queries", 1.0)}
    write_report(summary, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2


def test_seed_queries_and_switching_off(spark):
    seed = E.seed_queries(spark, AS_OF)
    assert column(E.list_queries(seed), "id") == ["Q1", "Q2", "Q3"]
    off = K.set_queries_active(seed, seed.filter("id = 'Q2'"), False)
    assert column(E.list_queries(off), "id") == ["Q1", "Q3"]
    assert E.list_queries(off, active_only=False).count() == 3
    back = K.put_eval_queries(off, frame(spark, "eval_queries", [{"id": "Q2", "query": "new"}]), "2025-01-01 00:00:00")
    row = back.filter("id = 'Q2'").first()
    assert (row["query"], row.label, row.total_relevant, row.active, str(row.created_at)) == ("new", "", 1, True, AS_OF)


@pytest.mark.parametrize("engine", ["token_hits", "bm25", "dense"])
def test_run_judge_and_measure(spark, engine):
    table = datasets(spark)
    corpus = search_corpus(table)
    embedder = DigestEmbedder()
    vectors = D.embed_catalog(table, frame(spark, "vectors", []), embedder, as_of=AS_OF)
    tables = E.EngineTables(table, artifacts(spark), corpus, build_term_index(corpus), vectors, embedder)
    queries = frame(spark, "eval_queries", [
        {"id": "T1", "label": "t", "query": "gauges moon", "total_relevant": 1, "active": True},
        {"id": "T2", "label": "t", "query": "zebra", "total_relevant": 1, "active": False}])
    run, results = E.run_eval(engine, tables, queries, k=3, label="try", as_of=AS_OF, run_id="r1")
    rows = results.orderBy("result_rank").collect()
    assert {r.query_id for r in rows} == {"T1"} and rows[0].result_rank == 1
    assert run.first().engine == engine
    none = frame(spark, "eval_judgments", [])
    assert E.query_metrics(results, none, queries, run).first().recall == 0.0
    judged = K.put_judgments(none, frame(spark, "eval_judgments", [
        {"query_id": "T1", "dataset_id": rows[0].dataset_id, "relevant": True}]))
    measured = E.query_metrics(results, judged, queries, run)
    assert [r.query_id for r in E.run_detail(results, measured, "r1").collect()] == ["T1"]
    assert E.run_detail(results, measured, "r2").collect() == []
    row = measured.first()
    assert row.recall == 1.0 and row.mrr == 1.0 and row.ap > 0
    again = K.put_run_results(results, results.filter("result_rank = 1").withColumn("title", F.lit("other")))
    assert again.filter("title = 'other'").count() == 1 and again.count() == len(rows)


def test_unknown_engine_and_bad_k(spark):
    tables = E.EngineTables(datasets(spark), artifacts(spark))
    queries = frame(spark, "eval_queries", [])
    with pytest.raises(ValueError, match="there are"):
        E.run_eval("nope", tables, queries)
    with pytest.raises(ValueError):
        E.run_eval("bm25", tables, queries, k=51)
