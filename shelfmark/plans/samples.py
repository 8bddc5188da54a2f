"""Sample rows: flattening, listing, fetching and row text search."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import json as J
from shelfmark.functions import text as X
from shelfmark.operators.keyed import lookup
from shelfmark.operators.ranking import page, top_k
from shelfmark.schemas import conform

_LINE = "id string, config string, split string, sampled_at string, rows array<string>"


def flatten_samples(lines: DataFrame, limit: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Sample lines (seq, value) to one row per sample that is an object; malformed lines are dropped.

    ``limit`` counts rows in input order. Row text is kept whole unless ``max_chars``
    is given (a text index may want C.ROW_TEXT_CHARS).
    """
    parsed = lines.select("seq", F.from_json("value", _LINE).alias("line"))
    rows = parsed.select("seq", "line.*", F.posexplode("line.rows").alias("row_index", "row")).drop("rows")
    rows = rows.filter(J.is_object(J.parse("row")))
    if limit:
        rows = rows.orderBy("seq", "row_index").limit(limit)
    key = [F.coalesce(c, F.lit("None")) for c in ("id", "config", "split")]
    return conform(
        rows.select(
            F.concat_ws("::", *key, F.col("row_index").cast("string")).alias("row_id"),
            F.col("id").alias("dataset_id"),
            "config", "split", "sampled_at", "row_index",
            J.row_text("row", max_chars).alias("row_text"),
            "row",
        ),
        "sample_rows",
    )


def text_match(query: str, column: str = "row_text") -> Column:
    """Whether a text shares an analysed term with the query."""
    asked = X.terms(F.lit(query))
    return F.arrays_overlap(X.terms(column), asked)


def sample_dataset_counts(rows: DataFrame, query: str | None = None) -> DataFrame:
    """(dataset_id, row_count) of datasets with rows, of those matching the query if one is given."""
    chosen = rows.filter(text_match(query)) if query else rows
    return chosen.groupBy("dataset_id").agg(F.count("*").alias("row_count"))


def list_sample_datasets(
    rows: DataFrame, query: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of datasets with sample rows, by id."""
    return page(sample_dataset_counts(rows, query), [F.col("dataset_id").asc()], limit, offset)


def sample_dataset_total(rows: DataFrame, query: str | None = None) -> DataFrame:
    """How many datasets have sample rows, over all pages."""
    return sample_dataset_counts(rows, query).agg(F.count("*").alias("total"))


_ROW_ORDER = ["config", "split", "row_index"]


def sample_rows(rows: DataFrame, dataset_id: str, limit: int = C.SAMPLE_ROWS_DEFAULT) -> DataFrame:
    """The first rows of one dataset by config, split and position."""
    own = rows.filter(F.col("dataset_id") == dataset_id).select("config", "split", "row_index", "row")
    return page(own, [F.col(c).asc() for c in _ROW_ORDER], limit)


def sample_rows_batch(
    rows: DataFrame, ids: DataFrame | None = None, limit: int = C.SAMPLE_ROWS_DEFAULT
) -> DataFrame:
    """The first rows of every dataset, or of the given ones (column dataset_id)."""
    wanted = rows if ids is None else lookup(rows, ids, ["dataset_id"])
    order = [F.col(c).asc() for c in _ROW_ORDER]
    return top_k(wanted, ["dataset_id"], order, limit).select("dataset_id", "rank", *_ROW_ORDER, "row")


def has_sample_rows(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits (dataset_id, …) with a flag whether the dataset has sample rows."""
    have = rows.select("dataset_id").distinct().withColumn("_have", F.lit(True))
    joined = hits.join(have, "dataset_id", "left")
    return joined.withColumn("has_sample_rows", F.col("_have").isNotNull()).drop("_have")
