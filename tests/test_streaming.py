from datetime import datetime

from pyspark.sql import functions as F

from catalogs import AS_OF, artifacts, column, datasets, frame
from shelfmark.plans import ingest as I
from shelfmark.sources.tables import append_log, write_snapshot
from shelfmark.streaming import streams


def signals(spark, rows):
    return frame(spark, "signals", [{"id": i, "dataset_id": d, "created_at": t} for i, d, t in rows])


def test_windowed_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(str(i), f"d{i % 3}", f"2024-01-{1 + i % 9:02d} 0{i % 10}:00:00") for i in range(40)]
    end = [("end", "late", "2024-03-01 00:00:00")]  # moves the watermark past all windows above
    log = str(tmp_path / "log")
    append_log(signals(spark, rows), log)
    append_log(signals(spark, end), log)
    stream = streams.stream_table(spark, "signals", log)
    counts = streams.windowed_signal_counts(stream)
    out = str(tmp_path / "out")
    query = (counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    table = streams.windowed_signal_counts(signals(spark, rows))
    assert got == sorted(map(tuple, table.collect())) and got


def test_repeated_ids_are_dropped(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a", "x", AS_OF), ("b", "x", AS_OF), ("a", "x", AS_OF)]
    write_snapshot(signals(spark, rows), log)
    stream = streams.without_repeats(streams.stream_table(spark, "signals", log))
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(column(spark.read.parquet(out), "id")) == ["a", "b"]


def test_listing_files_are_taken_in_once(spark, tmp_path):
    landing, state = tmp_path / "landing", tmp_path / "state"
    landing.mkdir()
    batches = []

    def take_in(batch, number):
        rows = batch.select(F.from_json("value", "id string, last_modified string").alias("r")).select("r.*")
        records, _ = I.ingest_listing(rows, as_of=AS_OF)
        applied = I.apply_records(datasets(spark), artifacts(spark), records, AS_OF)
        write_snapshot(applied.datasets.select("id"), str(state / f"batch={number}"))
        batches.append(sorted(column(records, "id")))

    def run():
        stream = streams.stream_lines(spark, str(landing))
        streams.run_available(stream, take_in, "listing", str(tmp_path / "cp")).awaitTermination()

    (landing / "1.jsonl").write_text('{"id":"n/a","last_modified":"2024-01-01T00:00:00Z"}\n')
    run()
    (landing / "2.jsonl").write_text('{"id":"n/b","last_modified":"2024-01-02T00:00:00Z"}\n')
    run()
    run()
    assert batches == [["n/a"], ["n/b"]]
    assert datetime.fromisoformat(AS_OF)
