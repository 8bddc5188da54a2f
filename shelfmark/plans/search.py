"""Keyword search: token hits (substring match) and BM25 (term match)."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import text as X
from shelfmark.functions.vectors import HITS, Best, best_of_block, hits_of
from shelfmark.operators.catalog import Filters, eligible_ids, fresh_artifact, signal_of
from shelfmark.operators.ranking import page, top_k
from shelfmark.session import materialised
from shelfmark.sources.tables import write_snapshot

# Queries go to the tasks in blocks of about this many bytes of query text; each block is one scan.
QUERY_BLOCK_BYTES = 8 << 20
# Scores held at a time by one task, and words whose tokens a task remembers.
BLOCK_SCORES = 4_000_000
REMEMBERED_WORDS = 200_000
# Scores are ranked as they are, but for the last bits, which tell the order of summation.
SCORE_DECIMALS = 10


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("dataset_id").asc()]


def query_tokens(query: str) -> list[str]:
    """Lower-case tokens between white space; repeated tokens stay."""
    return query.lower().split()


def matches(corpus: DataFrame, query: str) -> DataFrame:
    """(dataset_id, score) of every text that holds at least one token of the query."""
    tokens = query_tokens(query)
    wanted = F.lit(False)
    for token in dict.fromkeys(tokens):
        wanted = wanted | F.contains("content", F.lit(token))
    return corpus.filter(wanted).select("dataset_id", X.token_hits(F.col("content"), tokens).alias("score"))


def restrict(scored: DataFrame, datasets: DataFrame | None, filters: Filters | None) -> DataFrame:
    """Only datasets that exist and pass the filters.

    Rows that carry the columns that filters look at are filtered where they lie; without
    ``datasets`` they are taken to exist. Other rows are joined with the ids.
    """
    if datasets is None:
        return scored.filter(filters.condition()) if filters and filters.active else scored
    return scored.join(eligible_ids(datasets, filters), "dataset_id", "left_semi")


def hit_page(
    scored: DataFrame,
    datasets: DataFrame,
    artifacts: DataFrame,
    tokens: list[str],
    limit: int,
    offset: int,
    sample_rows: DataFrame | None = None,
) -> DataFrame:
    """The page of best hits with everything shown about a hit.

    Ranking runs on (dataset_id, score) alone and brings at most 100 rows to the driver.
    Their ids then filter the wide tables where they are scanned, so that no wide table
    is shuffled and the ranking is done once only.
    """
    if not 1 <= limit <= C.SEARCH_LIMIT_MAX:
        raise ValueError(f"limit must be from 1 to {C.SEARCH_LIMIT_MAX}")
    ranked = scored.select("dataset_id", F.col("score").cast("double").alias("score"))
    best = page(ranked, best_first(), limit, offset).collect()
    ids = [row["dataset_id"] for row in best]
    scores = datasets.sparkSession.createDataFrame([tuple(row) for row in best], "id string, score double")

    def having(rows: DataFrame, flag: str) -> DataFrame:
        found = rows.filter(F.col("dataset_id").isin(ids)).select(F.col("dataset_id").alias("id")).distinct()
        return F.broadcast(found.withColumn(flag, F.lit(True)))

    hits = datasets.filter(F.col("id").isin(ids)).join(F.broadcast(scores), "id")
    hits = hits.join(having(artifacts.filter(fresh_artifact()), "has_schema"), "id", "left")
    if sample_rows is not None:
        hits = hits.join(having(sample_rows, "has_sample_rows"), "id", "left")
    else:
        hits = hits.withColumn("has_sample_rows", F.lit(None).cast("boolean"))
    empty = F.array().cast("array<string>")
    return hits.select(
        "id", "title", "description", "readme_text",
        X.tokens_found(X.search_text(), tokens).alias("why"),
        F.coalesce("has_schema", F.lit(False)).alias("has_schema"),
        F.lit(None).cast("string").alias("blocked_reason"),
        "license_class", "access_class", "size_class",
        *[F.coalesce(c, empty).alias(c) for c in ("modalities", "languages", "tags")],
        signal_of("downloads").alias("downloads"),
        signal_of("likes").alias("likes"),
        F.coalesce("has_sample_rows", F.lit(False)).alias("has_sample_rows"),
        "score",
    ).orderBy(F.col("score").desc(), F.col("id"))


def search_tokens(
    corpus: DataFrame,
    datasets: DataFrame,
    artifacts: DataFrame,
    query: str,
    filters: Filters | None = None,
    limit: int = C.SEARCH_LIMIT_DEFAULT,
    offset: int = 0,
    sample_rows: DataFrame | None = None,
) -> DataFrame:
    """One page of datasets whose text holds any token of the query, most tokens first."""
    scored = restrict(matches(corpus, query), datasets, filters)
    return hit_page(scored, datasets, artifacts, query_tokens(query), limit, offset, sample_rows)


def search_total(corpus: DataFrame, datasets: DataFrame, query: str, filters: Filters | None = None) -> DataFrame:
    """How many datasets the query matches over all pages."""
    return restrict(matches(corpus, query), datasets, filters).agg(F.count("*").alias("total"))


def query_blocks(queries: DataFrame) -> Iterator[list]:
    """The queries (query_id, query) as lists of rows of bounded size, however many there are."""
    asked = queries.select("query_id", "query").filter("query is not null")
    blocks = -(-(asked.agg(F.sum(F.octet_length("query") + 16)).first()[0] or 0) // QUERY_BLOCK_BYTES)
    for block in range(blocks):
        yield sorted(asked.filter(F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)) == block).collect())


class WeightedTokens:
    """Tokens of a block of queries: which queries ask for each, and with what weight."""

    def __init__(self, asked: dict[str, list[tuple[int, float]]], query_ids: list[str]):
        self.query_ids = np.array(query_ids, dtype=object)
        self.tokens = sorted(asked)
        self.places = [np.array([q for q, _ in asked[t]]) for t in self.tokens]
        self.weights = [np.array([w for _, w in asked[t]]) for t in self.tokens]

    def scores(self, found: list[int], gains: list[float] | None = None) -> np.ndarray:
        """The score of one text for every query, given the tokens found in it; no hit is minus infinity."""
        if not found:
            return np.full(len(self.query_ids), -np.inf)
        places = np.concatenate([self.places[t] for t in found])
        weights = np.concatenate([self.weights[t] * (1.0 if gains is None else gains[i]) for i, t in enumerate(found)])
        total = np.bincount(places, weights=weights, minlength=len(self.query_ids))
        hit = np.zeros(len(self.query_ids), bool)
        hit[places] = True
        return np.where(hit, np.round(total, SCORE_DECIMALS), -np.inf)


class TokenFinder:
    """Which tokens occur in a text as substrings. Tokens hold no white space, so a text holds
    a token exactly if one of its words does; words that come again are remembered."""

    def __init__(self, tokens: list[str]):
        self.machine = ahocorasick.Automaton()
        for number, token in enumerate(tokens):
            self.machine.add_word(token, number)
        self.machine.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        found: set[int] = set()
        for word in set(text.split()):
            tokens = self.known.get(word)
            if tokens is None:
                tokens = tuple({number for _, number in self.machine.iter(word)})
                if len(self.known) < REMEMBERED_WORDS:
                    self.known[word] = tokens
            found.update(tokens)
        return sorted(found)


def _best_of_rows(scores: Iterator[tuple[str, np.ndarray]], queries: int, k: int) -> Best | None:
    """The k best per query out of (dataset_id, scores of all queries), a bounded block at a time."""
    step, best, ids, rows = max(1, BLOCK_SCORES // max(1, queries)), None, [], []

    def merged() -> Best:
        return best_of_block(np.array(rows).T, np.array(ids, dtype=str), k, best)

    for dataset_id, row in scores:
        ids.append(dataset_id)
        rows.append(row)
        if len(rows) == step:
            best, ids, rows = merged(), [], []
    return merged() if rows else best


def search_tokens_batch(
    corpus: DataFrame,
    datasets: DataFrame | None,
    queries: DataFrame,
    k: int,
    filters: Filters | None = None,
) -> DataFrame:
    """(query_id, rank, dataset_id, score): the k best datasets of every query (query_id, query).

    One scan of the corpus per block of queries: all tokens are looked for at once by an
    automaton, and each task scores its own texts and passes on the k best per query
    only. Queries without tokens have no hits. Leave ``datasets`` out if the corpus
    is a snapshot of them; filters then look at the corpus' own columns.
    """
    texts = restrict(corpus, datasets, filters).select("dataset_id", "content")
    best = queries.sparkSession.createDataFrame([], HITS)
    for block in query_blocks(queries):
        asked: dict[str, list[tuple[int, float]]] = {}
        for place, row in enumerate(block):
            for token, times in Counter(query_tokens(row["query"])).items():
                asked.setdefault(token, []).append((place, float(times)))
        if not asked:
            continue
        sent = texts.sparkSession.sparkContext.broadcast(WeightedTokens(asked, [r["query_id"] for r in block]))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            find = TokenFinder(wanted.tokens)

            def rows() -> Iterator[tuple[str, np.ndarray]]:
                for batch in batches:
                    for dataset_id, text in zip(batch.column("dataset_id").to_pylist(), batch.column("content").to_pylist()):
                        found = find(text or "")
                        if found:
                            yield dataset_id, wanted.scores(found)

            found = _best_of_rows(rows(), len(wanted.query_ids), k)
            if found is not None:
                yield hits_of(wanted.query_ids, found)

        best = best.unionByName(texts.mapInArrow(score, HITS))
    ranked = top_k(best, ["query_id"], best_first(), k)
    return ranked.select("query_id", "rank", "dataset_id", F.col("score").cast("bigint").alias("score"))


@dataclass(frozen=True)
class TermIndex:
    """Tables BM25 needs, one row per text: documents (dataset_id, doc_len, terms, tfs); terms (term, df); totals (n_docs, avg_len)."""

    documents: DataFrame
    terms: DataFrame
    totals: DataFrame


_TERM = re.compile(r"\w+")


def build_term_index(corpus: DataFrame, only: DataFrame | None = None) -> TermIndex:
    """Term counts of the corpus, from one pass over its texts.

    Texts stay in their tasks: a row holds the terms of one text, and only counts per
    term are shuffled. The rows are kept in the shared folder. ``only`` (query_id, query)
    keeps the terms that these queries ask for, of which there may be QUERY_BLOCK_BYTES.
    Columns of the corpus that filters look at are kept.
    """
    context = corpus.sparkSession.sparkContext
    wanted = None
    if only is not None:
        asked = only.select(F.explode(X.terms("query")).alias("term")).distinct()
        if (asked.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= QUERY_BLOCK_BYTES:
            wanted = context.broadcast(pa.array([r["term"] for r in asked.collect()], pa.string()))
    columns = [c for c in corpus.columns if c != "content"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.select(columns).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("content").to_pylist():
                found = _TERM.findall((text or "").lower())
                lengths.append(len(found))
                counts = Counter(found)
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            terms, tfs = pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))
            if wanted is not None:
                kept = pc.is_in(terms.flatten(), value_set=wanted.value)
                ends = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False))))
                offsets = pa.array(ends[terms.offsets.to_numpy()], pa.int32())
                terms = pa.ListArray.from_arrays(offsets, terms.flatten().filter(kept))
                tfs = pa.ListArray.from_arrays(offsets, tfs.flatten().filter(kept))
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lengths, pa.int32()), terms, tfs], [*columns, "doc_len", "terms", "tfs"])

    counted = corpus.select(*columns, "content").mapInArrow(count, f"{kinds}, doc_len int, terms array<string>, tfs array<int>")
    documents = materialised(counted, "terms")
    terms = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    totals = documents.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    return TermIndex(documents, terms, totals)


def store_term_index(index: TermIndex, folder: str) -> None:
    """Write the index to a new folder, to serve many searches."""
    write_snapshot(index.documents, f"{folder}/documents")
    write_snapshot(index.terms, f"{folder}/terms")
    write_snapshot(index.totals, f"{folder}/totals")


def load_term_index(spark: SparkSession, folder: str) -> TermIndex:
    return TermIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("documents", "terms", "totals")])


def _inverse_frequencies(index: TermIndex, terms: list[str]) -> tuple[dict[str, float], float]:
    """The inverse document frequency of the terms that occur, and the average length; terms come in bounded blocks."""
    spark = index.terms.sparkSession
    asked = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
    found = {r["term"]: r["df"] for r in index.terms.join(F.broadcast(asked), "term").collect()}
    totals = index.totals.first()
    idf = {t: float(np.log(1 + (totals["n_docs"] - df + 0.5) / (df + 0.5))) for t, df in found.items()}
    return idf, totals["avg_len"] or 1.0


def _gain(tf: float, doc_len: float, avg_len: float) -> float:
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * doc_len / avg_len))


def bm25_scores(index: TermIndex, query: str) -> DataFrame:
    """(dataset_id, score) of every text that holds a term of one query: Okapi BM25, a repeated term counting again."""
    asked = Counter(_TERM.findall(query.lower()))
    idf, avg_len = _inverse_frequencies(index, sorted(asked))
    score, hit = F.lit(0.0), F.lit(False)
    for term in sorted(idf):
        tf = F.get("tfs", F.array_position("terms", F.lit(term)).cast("int") - 1)
        score = score + F.coalesce(F.lit(idf[term] * asked[term]) * _gain(tf, F.col("doc_len"), F.lit(avg_len)), F.lit(0.0))
        hit = hit | F.array_contains("terms", F.lit(term))
    return index.documents.filter(hit).select("*", F.round(score, SCORE_DECIMALS).alias("score"))


def search_bm25_batch(
    index: TermIndex, datasets: DataFrame | None, queries: DataFrame, k: int, filters: Filters | None = None
) -> DataFrame:
    """(query_id, rank, dataset_id, score): the k best datasets of every query by BM25.

    One scan of the index per block of queries; each task scores its own texts and passes on
    the k best per query only. ``datasets`` as for search_tokens_batch.
    """
    rows = restrict(index.documents, datasets, filters).select("dataset_id", "doc_len", "terms", "tfs")
    best = queries.sparkSession.createDataFrame([], HITS)
    for block in query_blocks(queries):
        counts = [Counter(_TERM.findall(r["query"].lower())) for r in block]
        idf, avg_len = _inverse_frequencies(index, sorted(set().union(*counts)))
        asked: dict[str, list[tuple[int, float]]] = {}
        for place, terms in enumerate(counts):
            for term, times in terms.items():
                if term in idf:
                    asked.setdefault(term, []).append((place, times * idf[term]))
        if not asked:
            continue
        sent = rows.sparkSession.sparkContext.broadcast((WeightedTokens(asked, [r["query_id"] for r in block]), avg_len))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted, average = sent.value
            numbers = {term: i for i, term in enumerate(wanted.tokens)}

            def scored() -> Iterator[tuple[str, np.ndarray]]:
                for batch in batches:
                    for row in batch.to_pylist():
                        held = [(numbers[t], tf) for t, tf in zip(row["terms"], row["tfs"]) if t in numbers]
                        if held:
                            held.sort()
                            gains = [_gain(tf, row["doc_len"], average) for _, tf in held]
                            yield row["dataset_id"], wanted.scores([t for t, _ in held], gains)

            found = _best_of_rows(scored(), len(wanted.query_ids), k)
            if found is not None:
                yield hits_of(wanted.query_ids, found)

        best = best.unionByName(rows.mapInArrow(score, HITS))
    return top_k(best, ["query_id"], best_first(), k).select("query_id", "rank", "dataset_id", "score")


def search_bm25(
    index: TermIndex,
    datasets: DataFrame,
    artifacts: DataFrame,
    query: str,
    filters: Filters | None = None,
    limit: int = C.SEARCH_LIMIT_DEFAULT,
    offset: int = 0,
    sample_rows: DataFrame | None = None,
    fall_back: DataFrame | None = None,
) -> DataFrame:
    """One page of datasets by BM25.

    If no text holds a term of the query, the hits are token hits in the corpus given as ``fall_back``.
    """
    scored = restrict(bm25_scores(index, query), datasets, filters)
    if fall_back is not None and scored.isEmpty():
        return search_tokens(fall_back, datasets, artifacts, query, filters, limit, offset, sample_rows)
    return hit_page(scored, datasets, artifacts, query_tokens(query), limit, offset, sample_rows)
