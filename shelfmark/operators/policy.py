"""Decisions on requests: policy gate, cached answers, pausing, error classes."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import text as X
from shelfmark.operators.catalog import visible_artifacts


@dataclass(frozen=True)
class PolicySettings:
    budget_ms: int = C.RESOLVE_BUDGET_MS
    row_cap: int = C.RESOLVE_ROW_CAP
    license_allowlist: tuple[str, ...] = field(default_factory=lambda: tuple(C.LICENSE_ALLOWLIST))
    max_size_class: str | None = None
    p95_max_ms: float = C.RESOLVE_P95_MAX_MS
    queue_depth_max: int = C.QUEUE_DEPTH_MAX
    prefetch_enabled: bool = True


def _or_default(column: str, default: int) -> Column:
    given = F.col(column)
    return F.when(given.isNull() | (given == 0), F.lit(default)).otherwise(given)


def refusal(settings: PolicySettings) -> Column:
    """The first reason to refuse a request joined with its dataset, NULL if allowed."""
    access, license_class = F.col("access_class"), F.col("license_class")
    reason = (
        F.when(F.col("id").isNull(), "not_applicable")
        .when((access != "") & (access != "public"), "gated_private")
        .when((license_class != "") & ~license_class.isin(*settings.license_allowlist), "license_denied")
    )
    ceiling = C.SIZE_CLASSES.index(settings.max_size_class) if settings.max_size_class in C.SIZE_CLASSES else -1
    if ceiling >= 0:
        reason = reason.when(X.size_rank("size_class") > ceiling, "size_exceeded")
    over = (_or_default("budget_ms", settings.budget_ms) > settings.budget_ms) | (
        _or_default("row_cap", settings.row_cap) > settings.row_cap
    )
    return reason.when(over, "time_budget_exceeded")


def evaluate_policy(requests: DataFrame, datasets: DataFrame, settings: PolicySettings = PolicySettings()) -> DataFrame:
    """Requests (dataset_id, kind, budget_ms, row_cap, …) with ``allow`` and ``reason_code``."""
    facts = datasets.select("id", "access_class", "license_class", "size_class")
    joined = requests.join(facts, requests["dataset_id"] == facts["id"], "left")
    return joined.select(
        *[requests[c] for c in requests.columns], refusal(settings).alias("reason_code")
    ).withColumn("allow", F.col("reason_code").isNull())


def decide_requests(
    requests: DataFrame, artifacts: DataFrame, datasets: DataFrame, settings: PolicySettings = PolicySettings()
) -> DataFrame:
    """Each request as cached, denied or queued; queued ones get a job id and the budget to use."""
    have = visible_artifacts(artifacts).select("dataset_id", "kind", F.lit(True).alias("_cached"))
    judged = evaluate_policy(requests, datasets, settings).join(have, ["dataset_id", "kind"], "left")
    outcome = F.when(F.col("_cached"), "cached").when(~F.col("allow"), "denied").otherwise("queued")
    job = F.when(F.col("outcome") == "cached", F.concat(F.lit("cached-"), "dataset_id")).when(
        F.col("outcome") == "queued", F.uuid()
    )
    return (
        judged.withColumn("outcome", outcome)
        .withColumn("job_id", job)
        .withColumn("reason_code", F.when(F.col("outcome") == "denied", F.col("reason_code")))
        .withColumn("budget_ms", _or_default("budget_ms", settings.budget_ms))
        .withColumn("row_cap", _or_default("row_cap", settings.row_cap))
        .drop("_cached", "allow")
    )


def pause_reason(settings: PolicySettings = PolicySettings()) -> Column:
    """Why prefetching waits, from columns resolve_p95_ms and queue_depth; NULL if it may run."""
    reason = F.when(F.col("resolve_p95_ms") > settings.p95_max_ms, "resolve_slow").when(
        F.col("queue_depth") > settings.queue_depth_max, "queue_depth"
    )
    return reason if settings.prefetch_enabled else reason.otherwise("prefetch_disabled")


def error_class(kind: Column | str = "error_kind", status: Column | str = "http_status") -> Column:
    """Class of a failed fetch from its kind (timeout, http, transport, parse, …) and HTTP status."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    status = F.col(status) if isinstance(status, str) else status
    return (
        F.when(kind == "timeout", "timeout")
        .when((kind == "http") & (status == 429), "rate_limited")
        .when((kind == "http") & status.between(500, 599), "network")
        .when(kind == "transport", "network")
        .when(kind == "parse", "parse_error")
        .otherwise("unknown")
    )
