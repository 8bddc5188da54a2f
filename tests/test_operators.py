import json
import random

import pytest
from pyspark.sql import functions as F

from catalogs import AS_OF, artifacts, column, datasets, frame
from shelfmark.operators import keyed as K
from shelfmark.operators import metrics as M
from shelfmark.operators import policy as P
from shelfmark.operators import ranking
from shelfmark.operators.catalog import Filters
from shelfmark.operators.ranking import nth_smallest, page, top_k
from shelfmark.plans import health as H


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), ("a", 2, "w")], "k string, n int, v string")
    assert sorted(map(tuple, K.keep_last(df, ["k"], ["n"]).collect())) == [("a", 3, "z"), ("b", 2, "y")]
    assert sorted(map(tuple, K.keep_first(df, ["k"], ["n"]).collect())) == [("a", 1, "x"), ("b", 2, "y")]


def test_repeated_key_is_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    with pytest.raises(Exception, match="duplicate key: a"):
        K.require_unique(df, ["k"]).collect()


def test_upsert_replaces_and_adds(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, n int")
    assert sorted(map(tuple, K.upsert(base, new, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_change_events_and_staleness(spark):
    base = datasets(spark)
    new = datasets(spark, [
        {"id": "sea/tides", "fingerprint": "f1b"}, {"id": "sky/hail", "fingerprint": "f2"},
        {"id": "sky/new", "fingerprint": None}, {"id": "sea/charts", "fingerprint": None}])
    events = K.change_events(base, new, AS_OF)
    assert sorted((r.type, r.dataset_id) for r in events.collect()) == [
        ("dataset.changed", "sea/charts"), ("dataset.changed", "sea/tides"), ("dataset.discovered", "sky/new")]
    stale = K.mark_stale(artifacts(spark), events.filter("type = 'dataset.changed'"))
    assert {r.dataset_id: r.stale for r in stale.collect()} == {"sea/tides": True, "sky/hail": True}


def test_known_row_without_fingerprint_is_not_discovered(spark):
    base = datasets(spark, [{"id": "x", "fingerprint": None}])
    assert K.change_events(base, datasets(spark, [{"id": "x", "fingerprint": "f"}]), AS_OF).count() == 0


def test_event_and_signal_logs(spark):
    log = K.as_event_log(spark.createDataFrame([("d", "j1", 5)], "dataset_id string, job_id string, n int")).first()
    assert log.type == "unknown" and log.payload == '{"job_id":"j1","n":5}' and log.id and log.created_at
    signal = K.as_signal_log(spark.createDataFrame([("s", "view")], "session_id string, event string")).first()
    assert signal.id and signal.created_at and signal.rank is None


def test_connectors_keep_limits(spark):
    base = frame(spark, "connectors", [{"source": "a", "cursor": "c1", "qps_limit": 5, "backoff_state": "b"},
                                       {"source": "z", "cursor": "c9"}])
    new = frame(spark, "connectors", [{"source": "a"}, {"source": "n", "cursor": "c2", "qps_limit": 1}])
    got = {r.source: (r.cursor, r.qps_limit, r.backoff_state) for r in K.merge_connectors(base, new).collect()}
    assert got == {"a": (None, 5, "b"), "z": ("c9", None, None), "n": ("c2", 1, None)}


def test_nth_smallest_equals_sorting(spark):
    rng = random.Random(5)
    for n in (1, 2, 10, 57):
        pool = [-5, 0, 3, 1 << 21, 1 << 23, (1 << 45) + 7, -(1 << 50), 10**15]
        numbers = [rng.choice(pool) if rng.random() < 0.5 else rng.randrange(10**9) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in numbers], "v bigint")
        got = nth_smallest(df, "v", "greatest(floor(n * 0.95D), 1)").first()["v"]
        assert got == sorted(numbers)[max(int(n * 0.95) - 1, 0)]


def test_nth_smallest_of_nothing(spark):
    assert nth_smallest(spark.createDataFrame([], "v bigint"), "v", "1").collect()[0]["v"] is None


def test_p95_of_ten_is_the_ninth(spark):
    rows = [{"id": str(i), "state": "done", "started_at": "2024-01-01 00:00:00",
             "finished_at": f"2024-01-01 00:00:{i:02d}"} for i in range(1, 11)]
    assert M.resolve_p95(frame(spark, "jobs", rows)).first()[0] == 9000.0
    assert M.resolve_p95(frame(spark, "jobs", [])).first()[0] == 0.0


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 2, "hot").otherwise("cold").alias("g"), F.col("id").alias("v"))
    top = top_k(df, ["g"], [F.col("v").desc()], 3)
    assert column(top.filter("g = 'hot'").orderBy("rank"), "v") == [999, 998, 997]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_page(spark):
    df = spark.range(10)
    assert column(page(df, [F.col("id").desc()], 3, 2), "id") == [7, 6, 5]
    with pytest.raises(ValueError):
        page(df, [F.col("id")], 3, -1)


def test_deep_pages_equal_sorting(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 1000, f"r{i}") for i in range(1000)], "v int, r string").repartition(5)
    expected = [(r.v, r.r) for r in df.orderBy(F.col("v").desc()).collect()]
    monkeypatch.setattr(ranking, "DRIVER_ROWS", 20)
    for limit, offset in ((10, 0), (10, 5), (10, 500), (300, 650), (50, 990), (5, 2000)):
        got = page(df, [F.col("v").desc()], limit, offset).collect()
        assert sorted((r.v, r.r) for r in got) == sorted(expected[offset : offset + limit])
        assert got and set(got[0].asDict()) == {"v", "r"} or offset == 2000


def test_policy_first_reason_wins(spark):
    rows = [
        {"id": "open", "access_class": "public", "license_class": "mit", "size_class": "n<1K"},
        {"id": "unset", "access_class": None, "license_class": None, "size_class": None},
        {"id": "private", "access_class": "private", "license_class": "gpl", "size_class": "n>100M"},
        {"id": "gpl", "access_class": "public", "license_class": "gpl", "size_class": "n>100M"},
        {"id": "big", "access_class": "public", "license_class": "mit", "size_class": "n>100M"},
        {"id": "odd", "access_class": "public", "license_class": "", "size_class": "enormous"},
    ]
    asked = spark.createDataFrame(
        [("open", 0, None), ("unset", None, None), ("private", 9999, None), ("gpl", None, None), ("big", 9999, None),
         ("odd", None, 200), ("absent", None, None), ("open", 1501, None), ("open", 1500, 201)],
        "dataset_id string, budget_ms int, row_cap int").withColumn("kind", F.lit("schema"))
    settings = P.PolicySettings(max_size_class="1M<n<10M")
    got = sorted((r.dataset_id, r.budget_ms or 0, r.reason_code) for r in P.evaluate_policy(asked, datasets(spark, rows), settings).collect())
    assert got == sorted([
        ("open", 0, None), ("unset", 0, None), ("private", 9999, "gated_private"), ("gpl", 0, "license_denied"),
        ("big", 9999, "size_exceeded"), ("odd", 0, None), ("absent", 0, "not_applicable"),
        ("open", 1501, "time_budget_exceeded"), ("open", 1500, "time_budget_exceeded")], key=lambda r: (r[0], r[1], r[2] or ""))


def test_no_size_ceiling_by_default(spark):
    big = datasets(spark, [{"id": "big", "access_class": "public", "license_class": "mit", "size_class": "n>100M"}])
    asked = spark.createDataFrame([("big", "schema", None, None)], "dataset_id string, kind string, budget_ms int, row_cap int")
    assert P.evaluate_policy(asked, big).first().allow


def test_decisions(spark):
    asked = spark.createDataFrame(
        [("sea/tides", "schema", None, None), ("sea/tides", "stats", 100, 10), ("sky/hail", "schema", None, None),
         ("sea/charts", "schema", None, None)], "dataset_id string, kind string, budget_ms int, row_cap int")
    got = {(r.dataset_id, r.kind): r for r in P.decide_requests(asked, artifacts(spark), datasets(spark)).collect()}
    assert got["sea/tides", "schema"].job_id == "cached-sea/tides"
    assert got["sea/tides", "stats"].outcome == "queued" and got["sea/tides", "stats"].budget_ms == 100
    assert got["sky/hail", "schema"].outcome == "queued" and got["sky/hail", "schema"].row_cap == 200
    assert got["sea/charts", "schema"].reason_code == "gated_private"


def test_pause_reasons(spark):
    def reason(p95, depth, **settings):
        row = spark.createDataFrame([(float(p95), depth)], "resolve_p95_ms double, queue_depth int")
        return row.select(P.pause_reason(P.PolicySettings(**settings)).alias("r")).first().r

    assert reason(3001, 501) == "resolve_slow"
    assert reason(3000, 501) == "queue_depth"
    assert reason(3000, 500) is None
    assert reason(3000, 500, prefetch_enabled=False) == "prefetch_disabled"


def test_error_classes(spark):
    rows = [("timeout", None), ("http", 429), ("http", 503), ("http", 404), ("transport", None), ("parse", None), ("x", None)]
    df = spark.createDataFrame(rows, "error_kind string, http_status int")
    assert column(df.select(P.error_class().alias("c")), "c") == [
        "timeout", "rate_limited", "network", "unknown", "network", "parse_error", "unknown"]


def test_admin_metrics_of_an_empty_catalog(spark):
    row = H.admin_metrics(datasets(spark, []), artifacts(spark, []), frame(spark, "jobs", []), AS_OF).first()
    assert (row.freshness_pct, row.thin_readme_pct, row.public_with_schema_pct) == (0.0, 0.0, 0.0)
    assert (row.resolve_p95_ms, row.queue_depth, row.prefetch_paused) == (0.0, 0, False)


def test_admin_metrics_names_all_labels(spark):
    jobs = frame(spark, "jobs", [{"id": str(i), "state": f"s{i % 7}", "error_class": f"e{i % 300:03}"} for i in range(900)])
    row = H.admin_metrics(datasets(spark), artifacts(spark), jobs, AS_OF).first()
    assert json.loads(row.error_taxonomy) == {f"e{i:03}": 3 for i in range(300)}
    assert sum(json.loads(row.jobs_by_state).values()) == 900 and len(json.loads(row.jobs_by_state)) == 7


def test_state_and_prefetch(spark):
    jobs = frame(spark, "jobs", [
        {"id": "1", "dataset_id": "sky/hail", "state": "error", "enqueued_at": "2024-01-30 00:00:00"},
        {"id": "2", "dataset_id": "sea/tides", "state": "error", "enqueued_at": "2024-01-01 00:00:00"}])
    state = {r.id: (r.has_schema, r.has_snips, r.recent_errors)
             for r in M.dataset_state(datasets(spark), artifacts(spark), jobs, AS_OF).collect()}
    assert state == {"sea/tides": (1, 0, 0), "sky/hail": (0, 0, 1), "sea/charts": (0, 0, 0)}
    signals = frame(spark, "signals", [{"id": "s", "dataset_id": "sky/hail", "created_at": "2024-01-30 10:00:00"}])
    found = H.prefetch_candidates(datasets(spark), artifacts(spark), signals, 10, AS_OF)
    assert [(r.dataset_id, r.sig_score) for r in found.collect()] == [("sky/hail", 1)]
    assert H.prefetch_jobs(found, AS_OF).first().id == "prefetch-sky/hail"


def test_leases(spark):
    rows = [
        {"id": "lost", "state": "running", "attempts": 1, "started_at": "2024-01-30 23:59:00"},
        {"id": "young", "state": "running", "attempts": 1, "started_at": "2024-01-30 23:59:45"},
        {"id": "spent", "state": "running", "attempts": 3, "started_at": "2024-01-30 23:00:00"},
        {"id": "idle", "state": "queued", "attempts": 0}]
    jobs = frame(spark, "jobs", rows)
    assert column(H.stale_leases(jobs, AS_OF), "id") == ["lost"]
    assert H.stale_leases(jobs, AS_OF, timeout_s=0).count() == 0
    back = {r.id: (r.state, r.attempts, r.started_at is None) for r in H.requeue_stale(jobs, AS_OF).collect()}
    assert back["lost"] == ("queued", 1, True) and back["young"][0] == "running"


def test_filters_look_into_the_json_text(spark):
    ids = lambda f: sorted(column(datasets(spark).filter(f.condition()), "id"))
    assert ids(Filters(modality="EX")) == ["sea/charts", "sea/tides"]
    assert ids(Filters(license_class="mit")) == ["sea/tides"]
    assert ids(Filters(language="de", size_class="1M<n<10M")) == ["sea/charts"]
    assert len(ids(Filters(license_class=""))) == 3
