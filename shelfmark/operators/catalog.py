"""Predicates and projections over catalog tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import text as X


@dataclass(frozen=True)
class Filters:
    """Search filters; an empty value does not filter."""

    modality: str | None = None
    license_class: str | None = None
    size_class: str | None = None
    language: str | None = None

    @property
    def active(self) -> bool:
        return any([self.modality, self.license_class, self.size_class, self.language])

    def condition(self) -> Column:
        """Modality and language look into the list's JSON text; license and size must be equal."""
        wanted = F.lit(True)
        if self.modality:
            wanted = wanted & F.contains(X.json_text("modalities"), F.lit(self.modality.lower()))
        if self.license_class:
            wanted = wanted & (F.col("license_class") == self.license_class)
        if self.size_class:
            wanted = wanted & (F.col("size_class") == self.size_class)
        if self.language:
            wanted = wanted & F.contains(X.json_text("languages"), F.lit(self.language.lower()))
        return wanted


def eligible_ids(datasets: DataFrame, filters: Filters | None) -> DataFrame:
    chosen = datasets.filter(filters.condition()) if filters and filters.active else datasets
    return chosen.select(F.col("id").alias("dataset_id"))


# What filters look at; a corpus may carry it.
FILTER_COLUMNS = ["modalities", "license_class", "size_class", "languages"]


def search_corpus(datasets: DataFrame, with_filters: bool = False) -> DataFrame:
    """The text that search looks at, one row per dataset: a snapshot to be written by a job.

    The text comes out of a one-item explode, so that filters on it are not moved below
    it, where every mention of the text would put it together again. With the columns that
    filters look at, a search can be filtered without a join.
    """
    return datasets.select(
        F.col("id").alias("dataset_id"),
        *(FILTER_COLUMNS if with_filters else []),
        F.explode(F.array(X.search_text())).alias("content"),
    )


def fresh_artifact(kind: str = "schema") -> Column:
    return (F.col("kind") == kind) & ~F.col("stale")


def fresh_schema_ids(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter(fresh_artifact()).select("dataset_id").distinct()


def visible_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter(~F.col("stale"))


def thin_readme() -> Column:
    return (
        F.col("readme_tokens").isNull()
        | (F.col("readme_tokens") < C.THIN_README_TOKENS)
        | (F.col("readme_score") < C.THIN_README_SCORE)
    )


def signal_of(name: str) -> Column:
    """A numeric quality signal such as downloads; what is not a whole number is NULL."""
    return F.try_element_at("quality_signals", F.lit(name)).try_cast("bigint")


def metadata(datasets: DataFrame) -> DataFrame:
    """The nine descriptive columns of a dataset, absent lists as empty."""
    empty = F.array().cast("array<string>")
    return datasets.select(
        "id", "title", "description", "license_class", "access_class", "size_class",
        *[F.coalesce(c, empty).alias(c) for c in ("modalities", "languages", "tags")],
    )
