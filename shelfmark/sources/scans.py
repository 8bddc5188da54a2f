"""Scans of the raw inputs. Every scan keeps the input order in a column ``seq``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import json as J
from shelfmark.functions import text as X


def input_order() -> Column:
    """Position of a row in its input: file, place in the file, row."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of every line that is not blank."""
    lines = spark.read.text(path).select(input_order().alias("seq"), X.strip("value").alias("value"))
    return lines.filter(F.col("value") != "")


def _document_list(spark: SparkSession, path: str, name: str, required: bool) -> DataFrame:
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), J.parse("value").alias("document")
    )
    items = F.try_variant_get("document", f"$.{name}", "array<variant>")
    if required:
        message = F.concat(F.lit(f'no top-level "{name}" list in '), F.col("file"))
        items = F.coalesce(items, F.raise_error(message).cast("array<variant>"))
    return documents.select("file", F.posexplode(items).alias("position", "entry"))


def read_catalog_entries(spark: SparkSession, path: str) -> DataFrame:
    """(seq, position, entry) of catalog documents: JSON files with a list ``datasets``."""
    entries = _document_list(spark, path, "datasets", required=True)
    return entries.select(F.struct("file", "position").alias("seq"), "position", "entry")


def read_catalog_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, kind, payload) of the optional list ``artifacts`` of catalog documents."""
    entry = F.col("entry")
    return _document_list(spark, path, "artifacts", required=False).select(
        J.text_of(entry, "dataset_id").alias("dataset_id"),
        J.text_of(entry, "kind").alias("kind"),
        F.to_json(J.field(entry, "payload")).alias("payload"),
    )


def read_parquet_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows of enriched Parquet files with ``seq``; a limit cuts before any validation."""
    rows = spark.read.parquet(path).select("*", input_order().alias("seq"))
    return rows.orderBy("seq").limit(limit) if limit else rows


def read_readme_cards(spark: SparkSession, folder: str) -> DataFrame:
    """(card_key, card_text) of README side files; the key is the dataset id with '/' as '__'."""
    files = spark.read.option("pathGlobFilter", "*.README.md").text(folder, wholetext=True)
    text = X.strip("value")
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.README\.md$", "").alias("card_key"),
        F.when(text != "", text).alias("card_text"),
    )
