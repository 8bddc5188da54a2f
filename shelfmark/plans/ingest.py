"""Importers: raw rows to catalog records, rejects, change events and stale artifacts."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import json as J
from shelfmark.functions import text as X
from shelfmark.functions.times import before, iso_format, moment, parse_iso
from shelfmark.operators.keyed import as_event_log, change_events, keep_last, mark_stale, upsert
from shelfmark.schemas import conform
from shelfmark.session import materialised


@dataclass(frozen=True)
class Ingested:
    """Outcome of an import: records in table form with ``seq``, and rejected input rows."""

    records: DataFrame
    rejects: DataFrame

    def counters(self) -> DataFrame:
        """Rows per outcome: 'loaded' or the reason of rejection."""
        outcomes = self.records.select(F.lit("loaded").alias("outcome")).unionByName(
            self.rejects.select(F.col("reject_reason").alias("outcome"))
        )
        return outcomes.groupBy("outcome").agg(F.count("*").alias("rows"))

    def preview(self, rows: int = 10) -> DataFrame:
        """The first rows that a real run would load."""
        return self.records.orderBy("seq").limit(rows)


def _as_records(df: DataFrame) -> DataFrame:
    """Fixed catalog columns plus the input order."""
    return conform(df, "datasets", keep=["seq"])


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def _last_part(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, "/"), -1)


def _known_signals(**values: Column) -> Column:
    """A map of the signals that are not NULL; NULL if there are none."""
    pairs = []
    for name, value in values.items():
        pairs += [F.lit(name), value.cast("string")]
    known = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    return F.when(F.size(known) > 0, known)


# JSON lines ------------------------------------------------------------------


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Lines (seq, value) with the parsed object and the reason to reject it, if any."""
    row = F.col("row")
    # The first branch never applies. Its partition id keeps the optimizer from moving
    # filters on the reason below the parser, where every mention parses the line again.
    reason = (
        F.when(F.spark_partition_id() < 0, "never")
        .when(row.isNull(), "malformed")
        .when(~J.is_object(row), "not_object")
        .when(~J.is_text(J.field(row, "id")) | (J.text_of(row, "id") == ""), "id_not_text")
        .when(J.truthy(J.field(row, "disabled")), "disabled")
    )
    return lines.select("seq", "value", J.parse("value").alias("row")).withColumn("reject_reason", reason)


def project_jsonl(parsed: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Catalog records of accepted JSON lines."""
    row = F.col("row")

    def text(name: str) -> Column:
        return J.text_of(row, name)

    named = parsed.select("seq", "row", text("id").alias("id"), text("description").alias("description"))
    named = named.withColumn("ns_local_id", F.coalesce(_nonempty(text("name")), _last_part(F.col("id"))))
    sizes = J.field(row, "size_categories")
    features = J.field(J.field(row, "dataset_info"), "features")
    sha = F.when(F.is_variant_null(J.field(row, "sha")), "None").otherwise(F.coalesce(text("sha"), F.lit("")))
    tokens = X.token_count("description")
    return _as_records(
        named.select(
            "seq", "id", "ns_local_id", "description",
            F.lit(C.DEFAULT_SOURCE).alias("source"),
            F.coalesce(_nonempty(text("pretty_name")), F.col("ns_local_id")).alias("title"),
            J.strings_of(J.field(row, "tags")).alias("tags"),
            X.modalities_of(F.try_variant_get(row, "$.task_categories", "array<string>")).alias("modalities"),
            text("license").alias("license_class"),
            F.when(J.truthy(J.field(row, "private")), "private").otherwise("public").alias("access_class"),
            F.get(J.strings_of(sizes), F.lit(0)).alias("size_class"),
            J.strings_of(J.field(row, "language")).alias("languages"),
            parse_iso(text("last_modified")).alias("last_seen_lm"),
            F.concat(F.lit("v1jsonl:"), "id", F.lit(":"), sha).alias("fingerprint"),
            moment(as_of).alias("indexed_at"),
            tokens.alias("readme_tokens"),
            X.readme_score_linear(tokens).alias("readme_score"),
            F.when(J.truthy(J.field(row, "gated")), F.array(F.lit("gated"))).alias("eligibility_flags"),
            _known_signals(downloads=text("downloads"), likes=text("likes")).alias("quality_signals"),
            F.when(J.truthy(features), F.to_json(features)).alias("schema_hint"),
        )
    )


def ingest_jsonl(
    lines: DataFrame, limit: int | None = None, as_of: Column | datetime | str | None = None
) -> Ingested:
    """Import JSON lines (seq, value); ``limit`` counts valid rows in input order."""
    parsed = parse_jsonl(lines)
    valid = parsed.filter(F.col("reject_reason").isNull())
    if limit:
        valid = valid.orderBy("seq").limit(limit)
    rejects = parsed.filter(F.col("reject_reason").isNotNull()).select("seq", "value", "reject_reason")
    return Ingested(project_jsonl(valid, as_of), rejects)


# Enriched Parquet ------------------------------------------------------------


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def ingest_parquet(
    rows: DataFrame, cards: DataFrame | None = None, as_of: Column | datetime | str | None = None
) -> Ingested:
    """Import enriched rows (with ``seq``), joined with README cards (card_key, card_text)."""
    identifier = X.clean_string(_optional(rows, "id", "string"))
    failed = X.clean_string(_optional(rows, "enrich_error", "string"))
    reason = F.when(failed.isNotNull(), "enrich_error").when(identifier.isNull(), "no_id")
    marked = rows.withColumn("reject_reason", reason)
    rejects = marked.filter(F.col("reject_reason").isNotNull()).select("seq", F.to_json(
        F.struct(*[c for c in rows.columns if c != "seq"])).alias("value"), "reject_reason")

    valid = marked.filter(F.col("reject_reason").isNull())
    tags = X.clean_list(_optional(rows, "tags", "array<string>"))
    size_tag = F.get(F.filter(tags, lambda t: t.startswith("size_categories:")), F.lit(0))
    downloads = _optional(rows, "downloads", "string").try_cast("double").try_cast("bigint")
    facts = valid.select(
        "seq",
        identifier.alias("id"),
        F.coalesce(X.clean_string(_optional(rows, "name", "string")), _last_part(identifier)).alias("ns_local_id"),
        F.coalesce(_optional(rows, "is_private", "boolean"), F.lit(False)).alias("_private"),
        F.coalesce(_optional(rows, "is_gated", "boolean"), F.lit(False)).alias("_gated"),
        tags.alias("tags"),
        X.modalities_of(_optional(rows, "task_categories", "array<string>")).alias("modalities"),
        X.clean_list(_optional(rows, "languages", "array<string>")).alias("languages"),
        X.clean_string(_optional(rows, "license", "string")).alias("license_class"),
        X.clean_string(_optional(rows, "readme_sha256", "string")).alias("readme_sha256"),
        F.get(F.split(size_tag, ":", 2), F.lit(1)).alias("size_class"),
        _known_signals(downloads=downloads).alias("quality_signals"),
    )
    facts = facts.withColumn("_key", F.replace("id", F.lit("/"), F.lit("__")))
    if cards is not None:
        facts = facts.join(cards, facts["_key"] == cards["card_key"], "left")
    else:
        facts = facts.withColumn("card_text", F.lit(None).cast("string"))
    tokens = X.token_count("card_text")
    spaced = F.translate("ns_local_id", "-_", "  ")
    records = _as_records(
        facts.select(
            "seq", "id", "ns_local_id", "tags", "modalities", "languages", "license_class",
            "readme_sha256", "size_class", "quality_signals",
            F.lit(C.DEFAULT_SOURCE).alias("source"),
            X.title_case(spaced).alias("title"),
            F.col("card_text").alias("readme_text"),
            F.when(F.col("_private"), "private").otherwise("public").alias("access_class"),
            F.concat(F.lit("pipeline:"), "id").alias("fingerprint"),
            moment(as_of).alias("indexed_at"),
            tokens.alias("readme_tokens"),
            X.readme_score_linear(tokens).alias("readme_score"),
            F.when(F.col("_gated"), F.array(F.lit("gated"))).alias("eligibility_flags"),
        )
    )
    return Ingested(records, rejects)


# Catalog documents -----------------------------------------------------------


def validate_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog entries (seq, position, entry) split into valid ones and errors.

    Errors are (seq, label, reject_reason, message). Of a repeated id the first entry stays.
    """
    entry = F.col("entry")
    required = sorted(C.REQUIRED_ENTRY_FIELDS)
    absent = F.array_compact(
        F.array(*[F.when(J.field(entry, name).isNull(), F.lit(name)) for name in required])
    )
    identifier = J.text_of(entry, "id")
    label = F.when(J.truthy(J.field(entry, "id")), identifier).otherwise(
        F.concat(F.lit("entry["), F.col("position").cast("string"), F.lit("]"))
    )
    reason = F.when(F.size(absent) > 0, "missing_fields").when(
        ~J.is_text(J.field(entry, "id")) | (X.strip(identifier) == ""), "blank_id"
    )
    checked = entries.select(
        "seq", "entry", identifier.alias("id"), label.alias("label"), absent.alias("absent"),
        reason.alias("reject_reason"),
    )
    # Whether an entry is the first of its id is decided by a join on (id, seq), which
    # spreads evenly however often an id is repeated.
    first = (
        checked.filter(F.col("reject_reason").isNull())
        .groupBy("id")
        .agg(F.min("seq").alias("seq"))
        .withColumn("_first", F.lit(True))
    )
    marked = checked.join(first, ["id", "seq"], "left").withColumn(
        "reject_reason",
        F.coalesce("reject_reason", F.when(F.col("_first").isNull(), F.lit("duplicate_id"))),
    )
    names = F.concat(F.lit("['"), F.array_join("absent", "', '"), F.lit("']"))
    message = (
        F.when(F.col("reject_reason") == "missing_fields", F.concat(F.lit("missing required fields: "), names))
        .when(F.col("reject_reason") == "blank_id", F.lit("'id' must be a non-empty string"))
        .otherwise(F.lit("duplicate id — skipped"))
    )
    errors = marked.filter(F.col("reject_reason").isNotNull()).select(
        "seq", "label", "reject_reason", message.alias("message")
    )
    return marked.filter(F.col("reject_reason").isNull()).select("seq", "entry"), errors


def project_entries(valid: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Catalog records of valid entries, with defaults for absent fields."""
    entry = F.col("entry")

    def text(name: str) -> Column:
        return J.text_of(entry, name)

    def strings(name: str) -> Column:
        return F.try_variant_get(entry, f"$.{name}", "array<string>")

    tokens = X.token_count(text("readme_text"))
    access = J.field(entry, "access_class")
    plain = ["id", "source", "ns_local_id", "title", "description", "readme_text", "license_class", "size_class"]
    return _as_records(
        valid.select(
            "seq",
            *[text(name).alias(name) for name in plain],
            *[strings(name).alias(name) for name in ("tags", "modalities", "languages", "eligibility_flags")],
            F.when(access.isNull(), F.lit("public")).otherwise(text("access_class")).alias("access_class"),
            F.coalesce(_nonempty(text("fingerprint")), F.concat(F.lit("catalog:"), text("id"))).alias("fingerprint"),
            F.coalesce(parse_iso(text("indexed_at")), moment(as_of)).alias("indexed_at"),
            tokens.alias("readme_tokens"),
            X.readme_score_linear(tokens).alias("readme_score"),
            F.try_variant_get(entry, "$.quality_signals", "map<string,string>").alias("quality_signals"),
            F.when(
                J.is_text(J.field(entry, "schema_hint")), text("schema_hint")
            ).otherwise(F.to_json(J.field(entry, "schema_hint"))).alias("schema_hint"),
        )
    )


def ingest_catalog(entries: DataFrame, as_of: Column | datetime | str | None = None) -> Ingested:
    """Import catalog entries (seq, position, entry)."""
    valid, errors = validate_entries(entries)
    return Ingested(project_entries(valid, as_of), errors)


# Incremental listing ---------------------------------------------------------


def beyond_cursor(
    listing: DataFrame,
    cursor: tuple[str, str] | None = None,
    floor: Column | datetime | str | None = None,
) -> DataFrame:
    """Listing rows (id, last_modified as text or timestamp, …) newer than the cursor and not below the floor.

    Adds the parsed time as ``last_seen_lm``; rows without one are dropped.
    """
    seen = listing.withColumn("last_seen_lm", parse_iso(F.col("last_modified").cast("string")))
    new = seen.filter(F.col("last_seen_lm").isNotNull())
    if cursor is not None:
        time, identifier = cursor
        mark = F.struct(F.lit(time).cast("timestamp").alias("lm"), F.lit(identifier).alias("id"))
        new = new.filter(F.struct(F.col("last_seen_lm").alias("lm"), F.col("id").alias("id")) > mark)
    if floor is not None:
        new = new.filter(F.col("last_seen_lm") >= moment(floor))
    return new


def backfill_floor(window_days: int, as_of: Column | datetime | str | None = None) -> Column:
    if window_days not in C.BACKFILL_DAYS:
        raise ValueError(f"window_days must be one of {C.BACKFILL_DAYS}")
    return before(moment(as_of), days=window_days)


def project_listing(rows: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Catalog records of listing rows; the title is given by the card or missing."""
    local = F.when(
        F.contains("id", F.lit("/")), F.get(F.split("id", "/", 2), F.lit(1))
    ).otherwise(F.col("id"))
    license_class = _nonempty(_optional(rows, "license", "string"))
    title = _optional(rows, "card_title", "string") if "card_title" in rows.columns else F.col("id")
    return _as_records(
        rows.select(
            F.struct("last_seen_lm", "id").alias("seq"),
            "id",
            F.lit(C.DEFAULT_SOURCE).alias("source"),
            local.alias("ns_local_id"),
            title.alias("title"),
            F.coalesce(_optional(rows, "tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
            license_class.alias("license_class"),
            F.when(F.coalesce(_optional(rows, "private", "boolean"), F.lit(False)), "private")
            .otherwise("public")
            .alias("access_class"),
            "last_seen_lm",
            X.fingerprint(
                F.lit(C.DEFAULT_SOURCE), local, F.lit(""), iso_format("last_seen_lm"), F.lit(""), license_class
            ).alias("fingerprint"),
            moment(as_of).alias("indexed_at"),
            F.lit(0).alias("readme_tokens"),
            F.lit(0.0).alias("readme_score"),
            F.create_map(
                F.lit("downloads"), _optional(rows, "downloads", "string"),
                F.lit("likes"), _optional(rows, "likes", "string"),
                F.lit("gated"), _optional(rows, "gated", "string"),
            ).alias("quality_signals"),
        )
    )


def new_cursor(rows: DataFrame) -> DataFrame:
    """One row: the highest (last_seen_lm, id) of the rows taken in."""
    top = rows.agg(F.max(F.struct("last_seen_lm", "id")).alias("top"))
    return top.select("top.last_seen_lm", "top.id")


def ingest_listing(
    listing: DataFrame,
    cursor: tuple[str, str] | None = None,
    floor: Column | datetime | str | None = None,
    limit: int | None = None,
    newest_first: bool = False,
    as_of: Column | datetime | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, cursor row) of the listing rows beyond the cursor.

    With a limit the oldest rows are taken first, so that the next run goes on where
    this one stopped; ``newest_first`` takes the newest instead.
    """
    new = beyond_cursor(listing, cursor, floor)
    if limit:
        order = ["last_seen_lm", "id"]
        new = new.orderBy(*[F.col(c).desc() if newest_first else F.col(c).asc() for c in order]).limit(limit)
    return project_listing(new, as_of), new_cursor(new)


# Applying --------------------------------------------------------------------


@dataclass(frozen=True)
class Applied:
    """New snapshots after an import, and the change events to append."""

    datasets: DataFrame
    artifacts: DataFrame
    events: DataFrame


def apply_records(
    datasets: DataFrame,
    artifacts: DataFrame,
    records: DataFrame,
    as_of: Column | datetime | str | None = None,
) -> Applied:
    """Put records into the catalog: the last of a repeated id stays, one event per id.

    The records are worked out once and kept in the shared folder, so that the three
    results agree.
    """
    updates = materialised(keep_last(records, ["id"], ["seq"]).drop("seq"), "updates")
    changes = change_events(datasets, updates, as_of)
    changed = changes.filter(F.col("type") == "dataset.changed")
    return Applied(
        upsert(datasets.select(*updates.columns), updates, ["id"]),
        mark_stale(artifacts, changed),
        as_event_log(changes),
    )
