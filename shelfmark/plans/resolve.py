"""Schema resolution: declared features, else inferred from rows, else from the card."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import json as J
from shelfmark.functions.times import moment
from shelfmark.operators.keyed import as_event_log
from shelfmark.operators.policy import PolicySettings, decide_requests, error_class
from shelfmark.operators.ranking import top_k
from shelfmark.schemas import conform
from shelfmark.session import cut_lineage


def _text(value: Column, name: str) -> Column:
    text = J.text_of(value, name)
    return F.when(text != "", text)


def declared_features(info: DataFrame) -> DataFrame:
    """(dataset_id, features, config, split) out of info payloads (dataset_id, payload as JSON).

    The first split with features wins over top-level features; config and split
    default to those of the first split. Features are JSON text, NULL if undeclared.
    """
    value = F.col("value")
    parsed = info.select("dataset_id", J.parse("payload").alias("value"))
    splits = parsed.select(
        "dataset_id", "value", F.try_variant_get(value, "$.splits", "array<variant>").alias("splits")
    )
    first = F.get("splits", F.lit(0))
    withf = F.get(F.filter("splits", lambda s: J.truthy(J.field(s, "features"))), F.lit(0))
    chosen = splits.select(
        "dataset_id",
        "value",
        withf.alias("own"),
        F.coalesce(_text(value, "default_config"), _text(first, "config")).alias("config"),
        F.coalesce(_text(value, "default_split"), _text(first, "split")).alias("split"),
    )
    own, top = F.col("own"), J.field(value, "features")
    return chosen.select(
        "dataset_id",
        F.coalesce(F.to_json(J.field(own, "features")), F.when(J.truthy(top), F.to_json(top))).alias("features"),
        F.coalesce(_text(own, "config"), "config").alias("config"),
        F.coalesce(_text(own, "split"), "split").alias("split"),
    )


def infer_schema(rows: DataFrame, prefer_non_null: bool = False) -> DataFrame:
    """Fields of sample rows (dataset_id, row_index, row as JSON), one line per field.

    Result: dataset_id, position, name, dtype, nullable, examples. The type is that of
    the first occurrence (of the first that is not null, if asked for), examples are the
    first three values as JSON, and positions follow first appearance. A dataset with
    very many rows is reduced before every shuffle.
    """
    inner = F.get_json_object("row", "$.row")
    body = F.when(J.field(J.parse("row"), "row").isNotNull(), inner).otherwise(F.col("row"))
    entries = rows.select("dataset_id", "row_index", F.posexplode(J.ordered_entries(body)).alias("at", "entry"))
    values = entries.select(
        "dataset_id",
        F.col("entry.key").alias("name"),
        F.struct("row_index", "at").alias("seen"),
        J.dtype_of(F.col("entry.value")).alias("dtype"),
        F.coalesce(F.to_json("entry.value"), F.lit("null")).alias("example"),
    )
    is_null = F.col("dtype") == "null"
    first_type = F.min_by("dtype", "seen")
    if prefer_non_null:
        first_type = F.coalesce(F.min_by("dtype", F.when(~is_null, F.col("seen"))), first_type)
    fields = values.groupBy("dataset_id", "name").agg(
        F.min("seen").alias("seen"), first_type.alias("dtype"), F.max(is_null).alias("nullable")
    )
    three = top_k(values.select("dataset_id", "name", "seen", "example"), ["dataset_id", "name"],
                  [F.col("seen").asc()], 3)
    examples = three.groupBy("dataset_id", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda e: e.example).alias("examples")
    )
    return fields.join(examples, ["dataset_id", "name"]).select(
        "dataset_id", F.col("seen").alias("position"), "name", "dtype", "nullable", "examples"
    )


def schema_json(fields: DataFrame) -> DataFrame:
    """(dataset_id, features): the inferred fields of each dataset as one JSON list."""
    item = F.struct(
        "position",
        F.struct(
            "name", "dtype", "nullable", F.transform("examples", J.parse).alias("examples")
        ).alias("field"),
    )
    listed = fields.select("dataset_id", "position", F.to_json(item["field"]).alias("field"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "field")))
    return listed.groupBy("dataset_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda f: f.field), ","), F.lit("]")).alias("features")
    )


def card_features(cards: DataFrame) -> DataFrame:
    """(dataset_id, features) out of card payloads (dataset_id, payload as JSON).

    Features given as an object become a list of name and dtype, in written order.
    """
    raw = F.get_json_object("payload", "$.dataset_info.features")
    kind = J.parse("raw")

    def named(entry: Column) -> Column:
        value = entry.value
        dtype = F.when(J.is_object(value), J.text_of(value, "dtype")).otherwise(
            F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("None"))
        )
        return F.struct(entry.key.alias("name"), dtype.alias("dtype"))

    listed = F.to_json(F.transform(J.ordered_entries("raw"), named), {"ignoreNullFields": "false"})
    return (
        cards.select("dataset_id", raw.alias("raw"))
        .select(
            "dataset_id",
            F.when(J.is_object(kind), listed).when(J.is_list(kind), F.col("raw")).alias("features"),
        )
        .filter(F.col("features").isNotNull())
    )


@dataclass(frozen=True)
class Resolved:
    """Artifacts to put, finished job rows, and the events of both outcomes."""

    artifacts: DataFrame
    jobs: DataFrame
    events: DataFrame


def resolve_payloads(
    jobs: DataFrame,
    info: DataFrame,
    rows: DataFrame,
    cards: DataFrame,
    fetched_ms: str | None = None,
    settings: PolicySettings = PolicySettings(),
) -> DataFrame:
    """Jobs (id, dataset_id, kind, budget_ms, row_cap, …) with features, config, split and payload.

    ``info`` and ``cards`` hold one payload per dataset; ``rows`` are sample rows, of which
    each job sees its own first ``row_cap``, or as many as the settings say if it names none.
    ``fetched_ms`` names a column with the time a fetch took.
    """
    declared = declared_features(info)
    cap = F.when(F.col("row_cap") > 0, F.col("row_cap")).otherwise(settings.row_cap)
    undeclared = jobs.select("dataset_id", cap.alias("cap")).distinct().join(declared, "dataset_id").filter(
        F.coalesce("features", F.lit("[]")).isin("[]", "{}") & F.col("config").isNotNull() & F.col("split").isNotNull()
    )
    # Rows are cut to the largest number that any job asks for before they are shuffled to the join.
    own = ["dataset_id", "config", "split"]
    largest = undeclared.agg(F.max("cap")).first()[0] or 0
    first = top_k(rows.select(*own, "row_index", "row"), own, [F.col("row_index").asc()], largest)
    capped = first.join(undeclared.select(*own, "cap"), own).filter(F.col("rank") <= F.col("cap"))
    # Jobs of one dataset may differ in what they see, so a schema belongs to a dataset and a cap.
    seen = capped.withColumn("dataset_id", F.struct("dataset_id", "cap"))
    inferred = schema_json(infer_schema(seen)).select(
        F.col("dataset_id.dataset_id").alias("dataset_id"), F.col("dataset_id.cap").alias("_cap"), F.col("features").alias("_inferred")
    )
    carded = card_features(cards).withColumnRenamed("features", "_card")

    def given(name: str) -> Column:
        return F.when(~F.col(name).isin("[]", "{}"), F.col(name))

    budget = F.greatest(F.coalesce("budget_ms", F.lit(0)), F.lit(0))
    took = F.coalesce(F.col(fetched_ms), F.lit(0)) if fetched_ms else F.lit(0)
    joined = (
        jobs.withColumn("_cap", cap)
        .join(declared, "dataset_id", "left")
        .join(inferred, ["dataset_id", "_cap"], "left")
        .join(carded, "dataset_id", "left")
        .withColumn("features", F.coalesce(given("features"), given("_inferred"), given("_card")))
    )
    base = [
        "dataset_id",
        "kind",
        F.col("_cap").cast("int").alias("row_cap_applied"),
        took.cast("int").alias("fetched_ms"),
        budget.cast("int").alias("budget_ms_requested"),
        ((budget > 0) & (took > budget)).alias("budget_exhausted"),
        F.lit(C.CONNECTOR_SOURCE).alias("source"),
    ]
    keep = {"ignoreNullFields": "false"}
    with_schema = F.struct(*base, J.parse("features").alias("schema"), "config", "split")
    without = F.struct(*base, J.parse(F.lit("[]")).alias("schema"), F.lit("schema_not_available").alias("note"))
    payload = F.when(F.col("features").isNotNull(), F.to_json(with_schema, keep)).otherwise(F.to_json(without, keep))
    return joined.withColumn("payload", payload).drop("_inferred", "_card", "_cap")


def resolve_schemas(
    jobs: DataFrame,
    info: DataFrame,
    rows: DataFrame,
    cards: DataFrame,
    failures: DataFrame | None = None,
    as_of: Column | datetime | str | None = None,
    fetched_ms: str | None = None,
    settings: PolicySettings = PolicySettings(),
) -> Resolved:
    """Work off jobs: an artifact per job that could be fetched, an error for those in ``failures``.

    ``failures`` has (dataset_id, error_kind, http_status, error_detail) per dataset whose
    fetch failed.
    """
    now = moment(as_of)
    if failures is None:
        empty = "dataset_id string, error_kind string, http_status int, error_detail string"
        failures = jobs.sparkSession.createDataFrame([], empty)
    failed = failures.select("dataset_id", error_class().alias("_class"), F.col("error_detail").alias("_detail"))
    ok = jobs.join(failed, "dataset_id", "left_anti")
    bad = jobs.join(failed, "dataset_id")

    payloads = resolve_payloads(ok, info, rows, cards, fetched_ms, settings)
    made = F.struct("payload", F.coalesce("started_at", "enqueued_at").alias("created_at"))
    latest = payloads.groupBy("dataset_id", "kind").agg(F.max_by(made, F.struct("enqueued_at", "id")).alias("made"))
    artifacts = conform(latest.select("dataset_id", "kind", "made.*", F.lit(False).alias("stale")), "artifacts")

    done = ok.withColumn("state", F.lit("done")).withColumn("finished_at", now)
    error = (
        bad.withColumn("state", F.lit("error"))
        .withColumn("finished_at", now)
        .withColumn("error_class", F.col("_class"))
        .withColumn("error_detail", F.substring("_detail", 1, C.JOB_ERROR_DETAIL_CHARS))
    )
    good_events = ok.select(
        F.lit("dataset.resolved_ok").alias("type"), "dataset_id", F.col("id").alias("job_id"), "kind",
        now.alias("created_at"),
    )
    bad_events = bad.select(
        F.lit("dataset.resolved_err").alias("type"), "dataset_id", F.col("id").alias("job_id"), "kind",
        F.col("_class").alias("error_class"),
        F.substring("_detail", 1, C.EVENT_ERROR_DETAIL_CHARS).alias("error_detail"),
        now.alias("created_at"),
    )
    return Resolved(
        artifacts,
        conform(done, "jobs").unionByName(conform(error, "jobs")),
        as_event_log(good_events).unionByName(as_event_log(bad_events)),
    )


@dataclass(frozen=True)
class Submitted:
    """Decisions on requests, the job rows to enqueue and the events to append."""

    decisions: DataFrame
    jobs: DataFrame
    events: DataFrame


def submit_requests(
    requests: DataFrame,
    artifacts: DataFrame,
    datasets: DataFrame,
    settings: PolicySettings = PolicySettings(),
    as_of: Column | datetime | str | None = None,
) -> Submitted:
    """Decide on requests and make their jobs and events.

    The decisions are kept in the checkpoint folder first, as jobs and events must
    carry the same (random) job ids.
    """
    decisions = cut_lineage(decide_requests(requests, artifacts, datasets, settings))
    return Submitted(decisions, queued_jobs(decisions, as_of), request_events(decisions, as_of))


def queued_jobs(decisions: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Job rows of the requests that policy let through (see decide_requests)."""
    return conform(
        decisions.filter(F.col("outcome") == "queued").select(
            F.col("job_id").alias("id"), "dataset_id", "kind", F.lit("queued").alias("state"),
            F.lit(0).alias("attempts"), "budget_ms", "row_cap", moment(as_of).alias("enqueued_at"),
        ),
        "jobs",
    )


def request_events(decisions: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """A ``dataset.requested`` event per queued request."""
    return as_event_log(
        decisions.filter(F.col("outcome") == "queued").select(
            F.lit("dataset.requested").alias("type"), "dataset_id", "job_id", "kind", "budget_ms", "row_cap",
            moment(as_of).alias("created_at"),
        )
    )
