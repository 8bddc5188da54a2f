"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import token_files
from shelfmark.llm.decontamination import decontaminate
from shelfmark.llm.mixing import mix
from shelfmark.llm.id_filter import without
from shelfmark.llm.ngram_join import ngram_groups
from shelfmark.llm.quality import keep_good
from shelfmark.llm.queries import TOKENIZER, table, tokenizer_path
from shelfmark.llm.texts import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Whole documents go through Python workers in batches of so many bytes at most, or one document.
BATCH_BYTES = 8 << 20


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays: the one with the smallest doc_id."""
    copies = written(ngram_groups(docs, with_links=False).filter("doc_id <> component_id").select("doc_id"), "copies")
    return without(docs, copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the target weights of their sources ask for: never, once or twice."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row per copy as read back from them."""
    return token_files.token_output(docs, tokenizer_path(f"{TOKENIZER}.json"))


STAGES: list[tuple[str, Stage]] = [
    (stage.__name__, in_small_batches(stage)) for stage in (quality, near_copies, decontamination, mixing, token_output)
]

# Compression scores and the tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
