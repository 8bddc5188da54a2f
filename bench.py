"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The test tables are single files of one row group, which one core would read. As tables
of many files are the case at scale, they are first copied into as many files as there are
cores; that is not timed.
"""

import json
import os
import tempfile
import time

from shelfmark.session import build_session
from shelfmark.workload import all_queries

HEADLINE = [
    "search_tokens",
    "search_tokens_filtered",
    "search_total",
    "search_tokens_batch",
    "search_sources_batch",
    "search_bm25",
    "search_bm25_batch",
    "bm25_corpus_stats",
    "dense_topk",
    "dense_topk_filtered",
    "dense_topk_batch",
    "dense_neighbours",
    "embed_hash",
    "vectors_replaced",
    "vector_migration",
    "state_view",
    "admin_metrics",
    "resolve_p95",
    "prefetch_candidates",
    "policy_check",
    "resolve_decision",
    "requeue_stale",
    "canonical_projection",
    "parquet_records",
    "listing_increment",
    "upsert_datasets",
    "change_events",
    "readme_stats",
    "flatten_samples",
    "sample_rows_topn",
    "infer_schema",
    "resolve_artifacts",
    "run_eval",
    "eval_metrics",
    "eval_run_history",
    "eval_report_rows",
    "signals_windowed",
]


def copied(spark, folder: str, parts: int) -> str:
    """The tables in several files each, in a new folder."""
    target = tempfile.mkdtemp(prefix="shelfmark-bench-")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            spark.read.parquet(os.path.join(folder, name)).repartition(parts).write.parquet(os.path.join(target, name))
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "shelfmark-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.files.openCostInBytes": "0",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shelfmark-bench-shared-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, tables = all_queries(), copied(spark, folder, int(cpus))

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("search_tokens", "dense_topk"):  # start the JVM's and Python's workers
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
