"""The operators of this package as queries over the given tables, with SQL where SQL can express them."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import token_counts as T
from shelfmark.llm.conversation_repair import repair_conversations
from shelfmark.llm.decontamination import find_leaks
from shelfmark.llm.exact_dedup import DEDUP_SQL, exact_groups
from shelfmark.llm.html_text import extract_main_text
from shelfmark.llm.licenses import scan_licenses
from shelfmark.llm.mixing import MIX_SQL, mix_report
from shelfmark.llm.ngram_join import ngram_groups
from shelfmark.llm.quality import score_quality
from shelfmark.llm.ranked_search import SEARCH_SQL, ranked_search
from shelfmark.llm.texts import shared_path, written
from shelfmark.llm.token_files import token_output
from shelfmark.llm.toxicity import score_toxicity
from shelfmark.llm.url_filter import URL_SQL, judge_urls, query_rules

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOKENIZER = "word_bpe_49k"


@query("op1_token_counts")
def token_counts(spark, folder):
    """Counts after three batches: all documents come, those labelled bad go, toxic ones move to a source of their own.

    The last batch is sent twice; the second time changes nothing.
    """
    labels = table(spark, folder, "labels")
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    toxic = labels.filter("toxic = 1").select("doc_id").distinct().join(bad, "doc_id", "left_anti")
    counts = written(T.count_tokens(table(spark, folder, "documents"), {TOKENIZER: tokenizer_path(f"{TOKENIZER}.json")}), "counts")
    store = shared_path(spark, "token-counts")
    T.commit(store, "1", T.inserted(counts))
    T.commit(store, "2", T.deleted(counts.join(bad, "doc_id", "left_semi")))
    moved = counts.join(toxic, "doc_id", "left_semi")
    for _ in range(2):
        T.commit(store, "3", T.revised(moved, moved.withColumn("source", F.lit("quarantine"))))
    return T.totals(spark, store)


@query("op2_toxicity")
def toxicity(spark, folder):
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_token_files")
def token_files(spark, folder):
    return token_output(table(spark, folder, "documents"), tokenizer_path(f"{TOKENIZER}.json"))


@query("op4_ngram_join")
def ngram_join(spark, folder):
    return ngram_groups(table(spark, folder, "documents"))


@query("op5_exact_dedup", DEDUP_SQL)
def exact_dedup(spark, folder):
    return exact_groups(table(spark, folder, "documents"))


@query("op6_decontamination")
def decontamination(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_quality")
def quality(spark, folder):
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_licenses")
def licenses(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))


@query("op9_mixing", MIX_SQL)
def mixing(spark, folder):
    return mix_report(table(spark, folder, "documents"))


@query("op10_html_text")
def html_text(spark, folder):
    return extract_main_text(table(spark, folder, "pages"))


@query("op11_conversation_repair")
def conversation_repair(spark, folder):
    return repair_conversations(table(spark, folder, "conversations"))


@query("op12_ranked_search", SEARCH_SQL)
def lexical_search(spark, folder):
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_url_filter", URL_SQL)
def url_filter(spark, folder):
    return judge_urls(table(spark, folder, "pages"), query_rules(spark))
