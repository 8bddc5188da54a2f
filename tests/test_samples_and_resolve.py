import json

from catalogs import AS_OF, column, datasets, frame
from shelfmark.operators.policy import decide_requests
from shelfmark.plans import resolve as R
from shelfmark.plans import samples as S
from shelfmark.sources import scans, tables


def lines(spark, tmp_path):
    docs = [
        {"id": "d1", "config": "c", "split": "train", "sampled_at": "2024-01-01", "rows": [{"t": "The cat", "n": 1}, "text", {"ok": True, "x": [1]}]},
        {"id": "d2", "config": None, "split": "test", "sampled_at": None, "rows": [{"t": "dog"}]},
        {"id": "d3", "config": "c", "split": "train", "sampled_at": None, "rows": None},
    ]
    path = tmp_path / "samples.jsonl"
    path.write_text("\n".join([json.dumps(docs[0]), "", "{oops", json.dumps(docs[1]), json.dumps(docs[2])]))
    return scans.read_lines(spark, str(path))


def test_flatten(spark, tmp_path):
    rows = S.flatten_samples(lines(spark, tmp_path)).orderBy("row_id").collect()
    assert [(r.row_id, r.row_index, r.row_text) for r in rows] == [
        ("d1::c::train::0", 0, "The cat 1"), ("d1::c::train::2", 2, "True"), ("d2::None::test::0", 0, "dog")]
    assert json.loads(rows[1].row) == {"ok": True, "x": [1]}
    assert S.flatten_samples(lines(spark, tmp_path), limit=2).count() == 2


def rows_table(spark):
    return frame(spark, "sample_rows", [
        {"row_id": f"{d}{i}", "dataset_id": d, "config": c, "split": "train", "sampled_at": "1", "row_index": i,
         "row_text": t, "row": "{}"}
        for d, c, i, t in [("a", "z", 0, "The cat"), ("a", "y", 1, "a dog"), ("b", "y", 0, "category"), ("c", "y", 2, "CAT!")]])


def test_listing_and_text_match(spark):
    rows = rows_table(spark)
    assert [tuple(r) for r in S.list_sample_datasets(rows).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert [tuple(r) for r in S.list_sample_datasets(rows, "cat, bird").collect()] == [("a", 1), ("c", 1)]
    assert column(S.list_sample_datasets(rows, limit=1, offset=1), "dataset_id") == ["b"]
    assert S.sample_dataset_total(rows, "dog").first().total == 1


def test_rows_of_datasets(spark, tmp_path):
    rows = rows_table(spark)
    assert column(S.sample_rows(rows, "a"), "config") == ["y", "z"]
    batch = S.sample_rows_batch(rows, rows.filter("dataset_id <> 'b'"), limit=1)
    assert sorted((r.dataset_id, r.config) for r in batch.collect()) == [("a", "y"), ("c", "y")]
    flags = S.has_sample_rows(spark.createDataFrame([("a",), ("q",)], "dataset_id string"), rows)
    assert {r.dataset_id: r.has_sample_rows for r in flags.collect()} == {"a": True, "q": False}
    newer = rows.filter("row_id = 'a0'").selectExpr("* except (sampled_at, row_text)", "'2' as sampled_at", "'new' as row_text")
    path = str(tmp_path / "store")
    tables.write_sample_rows(rows.unionByName(newer), path, buckets=4)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    assert sorted(column(tables.read_dataset_rows(stored, "a", buckets=4), "row_text")) == ["a dog", "new"]


def test_schema_of_mixed_rows(spark):
    rows = [('{"b":null,"a":1}'), ('{"a":"x","c":{"k":1}}'), ('{"row":{"b":2,"d":[1],"e":1.0}}'), ('{"a":true}'), ('{"a":2}')]
    df = spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)], "dataset_id string, row_index int, row string")
    fields = R.infer_schema(df).orderBy("position").collect()
    assert [(f.name, f.dtype, f.nullable) for f in fields] == [
        ("b", "null", True), ("a", "int64", False), ("c", "struct", False), ("d", "array", False), ("e", "float64", False)]
    assert fields[1].examples == ["1", '"x"', "true"]
    better = {f.name: f.dtype for f in R.infer_schema(df, prefer_non_null=True).collect()}
    assert better["b"] == "int64"
    listed = json.loads(R.schema_json(R.infer_schema(df)).first().features)
    assert listed[1] == {"name": "a", "dtype": "int64", "nullable": False, "examples": [1, "x", True]}
    assert listed[0]["examples"] == [None, 2]


def test_resolution_order(spark):
    jobs = frame(spark, "jobs", [
        {"id": f"j-{d}", "dataset_id": d, "kind": "schema", "state": "queued", "row_cap": cap, "budget_ms": 1500, "enqueued_at": AS_OF}
        for d, cap in [("declared", 200), ("rows", 1), ("card", 200), ("nothing", 0), ("failed", 200)]])
    info = spark.createDataFrame([
        ("declared", '{"splits":[{"config":"c","split":"s","features":[{"name":"f"}]}]}'),
        ("rows", '{"splits":[{"config":"c","split":"s"}]}'), ("card", '{}')], "dataset_id string, payload string")
    rows = spark.createDataFrame([
        ("rows", "c", "s", 0, '{"x":1}'), ("rows", "c", "s", 1, '{"y":1}'), ("rows", "other", "s", 0, '{"z":1}')],
        "dataset_id string, config string, split string, row_index int, row string")
    cards = spark.createDataFrame([("card", '{"dataset_info":{"features":{"z":{"dtype":"int8"},"a":"string"}}}'),
                                   ("declared", '{"dataset_info":{"features":{"no":"x"}}}')], "dataset_id string, payload string")
    failures = spark.createDataFrame([("failed", "http", 429, "slow down")], "dataset_id string, error_kind string, http_status int, error_detail string")
    done = R.resolve_schemas(jobs, info, rows, cards, failures, AS_OF)
    payloads = {r.dataset_id: json.loads(r.payload) for r in done.artifacts.collect()}
    assert payloads["declared"]["schema"] == [{"name": "f"}] and payloads["declared"]["config"] == "c"
    assert [f["name"] for f in payloads["rows"]["schema"]] == ["x"] and payloads["rows"]["row_cap_applied"] == 1
    assert payloads["card"]["schema"] == [{"name": "z", "dtype": "int8"}, {"name": "a", "dtype": "string"}]
    assert payloads["card"]["config"] is None
    assert payloads["nothing"]["note"] == "schema_not_available" and payloads["nothing"]["row_cap_applied"] == 200
    assert "failed" not in payloads
    states = {r.dataset_id: (r.state, r.error_class) for r in done.jobs.collect()}
    assert states["failed"] == ("error", "rate_limited") and states["card"] == ("done", None)
    kinds = sorted(column(done.events, "type"))
    assert kinds == ["dataset.resolved_err"] + ["dataset.resolved_ok"] * 4


def test_jobs_and_events_carry_the_same_ids(spark):
    asked = spark.createDataFrame(
        [("sea/tides", "stats", 10, None), ("sky/hail", "schema", None, 5), ("sea/charts", "schema", None, None)],
        "dataset_id string, kind string, budget_ms int, row_cap int")
    done = R.submit_requests(asked, frame(spark, "artifacts", []), datasets(spark), as_of=AS_OF)
    jobs = {r.dataset_id: r.id for r in done.jobs.collect()}
    events = {r.dataset_id: json.loads(r.payload)["job_id"] for r in done.events.collect()}
    assert jobs == events and sorted(jobs) == ["sea/tides", "sky/hail"]


def test_requests_become_jobs_and_events(spark):
    asked = spark.createDataFrame([("sea/tides", "schema", None, None)], "dataset_id string, kind string, budget_ms int, row_cap int")
    decided = decide_requests(asked, frame(spark, "artifacts", []), datasets(spark))
    job = R.queued_jobs(decided, AS_OF).first()
    assert (job.state, job.attempts, job.budget_ms, job.row_cap) == ("queued", 0, 1500, 200)
    event = R.request_events(decided, AS_OF).first()
    assert event.type == "dataset.requested" and json.loads(event.payload)["row_cap"] == 200
