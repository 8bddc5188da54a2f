"""Row types of the catalog tables."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "datasets": (
        "id string, source string, ns_local_id string, title string, description string, "
        "readme_text string, tags array<string>, modalities array<string>, license_class string, "
        "access_class string, size_class string, languages array<string>, last_seen_lm timestamp, "
        "readme_sha256 string, card_sha256 string, fingerprint string, indexed_at timestamp, "
        "readme_tokens int, readme_score double, eligibility_flags array<string>, "
        "quality_signals map<string,string>, schema_hint string"
    ),
    "artifacts": "dataset_id string, kind string, payload string, created_at timestamp, stale boolean",
    "jobs": (
        "id string, dataset_id string, kind string, state string, attempts int, budget_ms int, "
        "row_cap int, error_class string, error_detail string, enqueued_at timestamp, "
        "started_at timestamp, finished_at timestamp"
    ),
    "events": "id string, type string, dataset_id string, payload string, created_at timestamp",
    "signals": (
        "id string, session_id string, user_id string, event string, dataset_id string, "
        "query string, rank int, created_at timestamp"
    ),
    "connectors": "source string, cursor string, qps_limit int, backoff_state string",
    "vectors": "dataset_id string, model string, vector array<float>, updated_at timestamp",
    "eval_queries": (
        "id string, label string, query string, target_id string, total_relevant int, "
        "active boolean, created_at timestamp"
    ),
    "eval_judgments": (
        "query_id string, dataset_id string, relevant boolean, judged_by string, judged_at timestamp"
    ),
    "eval_runs": "id string, label string, engine string, k int, created_at timestamp",
    "eval_run_results": (
        "run_id string, query_id string, result_rank int, dataset_id string, title string, extra string"
    ),
    "sample_rows": (
        "row_id string, dataset_id string, config string, split string, sampled_at string, "
        "row_index int, row_text string, row string"
    ),
}


def conform(df: DataFrame, table: str, keep: list[str] | None = None) -> DataFrame:
    """Project to the fixed columns of a table, casting, absent columns as NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in present else 'null'} as {f.dataType.simpleString()}) as {f.name}"
            for f in T.StructType.fromDDL(TABLES[table]).fields
        ],
        *(keep or []),
    )
