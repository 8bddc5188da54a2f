"""Requests decided by a stream: the rules on plain rows, and independence of the order of arrival."""

import random

import pytest

from shelfmark.streaming import requests as RQ

HOUR = 3_600_000_000


def decide(rows, until=1_000 * HOUR, hours=2, attempts=2):
    state = [False, None, 0, None, None]
    processor = RQ.RequestProcessor(hours * 3600, attempts)
    ready = [(int(at * HOUR), name, action) for at, name, action in rows]
    return [(name, at / HOUR, outcome, job) for name, at, outcome, job in processor._decide(state, ready, until)], state


def test_one_job_serves_all_requests_until_it_is_done():
    got, _ = decide([(1, "a", "request"), (1, "b", "request"), (2, "s", "start"), (3, "d", "done"), (4, "c", "request"), (5, "x", "stale"), (6, "e", "request")])
    assert got == [("a", 1, "queued", "a"), ("b", 1, "joined", "a"), ("c", 4, "cached", None), ("e", 6, "queued", "e")]


def test_lost_leases_are_queued_again_up_to_the_last_attempt():
    got, state = decide([(1, "a", "request"), (2, "s", "start"), (5, "b", "request"), (6, "t", "start")])
    assert got == [("a", 1, "queued", "a"), ("s", 4, "requeued", "a"), ("b", 5, "joined", "a"), ("t", 8, "given up", "a")]
    assert state == [False, "a", 2, None, None]


def test_a_lease_ends_with_the_job_or_with_another_start():
    got, _ = decide([(1, "a", "request"), (2, "s", "start"), (4, "t", "start"), (6, "f", "failed"), (7, "b", "request")])
    assert got == [("a", 1, "queued", "a"), ("b", 7, "queued", "b")]  # at the end of the lease is in time
    got, _ = decide([(1, "s", "start"), (2, "d", "failed")])
    assert got == []  # nobody asked
    got, _ = decide([(1, "a", "request"), (2, "s", "start")], until=3 * HOUR)
    assert got == [("a", 1, "queued", "a")]  # the lease still runs


@pytest.mark.parametrize("parts", [1, 2])
def test_outcomes_do_not_depend_on_arrival(spark, tmp_path, parts):
    draw = random.Random(3)
    rows = []
    for i in range(120):
        day, hour = divmod(draw.randrange(96), 24)
        action = draw.choice(["request", "request", "start", "done", "failed", "stale", "unknown"])
        rows.append((f"{i:03d}", draw.choice(["x", "y", None]), "schema", action, f"2024-01-0{1 + day} {hour:02d}:30:00"))
    rows.append((None, "z", "schema", "request", "2024-01-02 00:00:00"))
    rows.append(("no time", "z", "schema", "request", None))
    end = [("end", "", "schema", "stale", "2030-01-01 00:00:00")]
    draw.shuffle(rows)
    log = str(tmp_path / "log")
    steps = [rows[n::parts] for n in range(parts)] + [end]
    for n, step in enumerate(steps):
        frame = spark.createDataFrame(step, "id string, dataset_id string, kind string, action string, at string")
        frame.withColumn("at", frame["at"].cast("timestamp")).write.parquet(f"{log}/step={n}")
        stream = spark.readStream.schema(RQ.LOG).parquet(f"{log}/*")
        RQ.run_decisions(RQ.decide_stream(stream, "10 days", 7200, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [tuple(r) for r in spark.read.schema(RQ.OUTCOMES).parquet(str(tmp_path / "out")).collect()]
    want = []
    for dataset in ("x", "y", "z"):
        times = {f"{at}": spark.sql(f"select unix_micros(timestamp'{at}')").first()[0] for *_, at in rows if at}
        mine = sorted((times[at], name or "", action) for name, d, _, action, at in rows if d == dataset and at and action != "unknown")
        decided = RQ.RequestProcessor(7200, 2)._decide([False, None, 0, None, None], mine, 10**16)
        want += [(dataset, "schema", name, at, outcome, job) for name, at, outcome, job in decided]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[4] for r in want} >= {"queued", "joined", "cached", "requeued"}
