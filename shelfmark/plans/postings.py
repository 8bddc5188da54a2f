"""BM25 over an inverted index with block maxima.

Texts are cut where they lie into ranges of at most ``block_docs``, which are numbered densely; a text's number
is made of its range and its place there. The list of
a term is a row per range: the texts of the range that hold it (as offsets from its
begin), their counts and lengths, and the largest gain any of them has. So
no list is longer than a range, however common its term. Rows lie in folders by a hash of their
term and are sorted by it, so a search reads the files of its terms only.

A search first looks at the maxima alone: what a text of a range can reach at most. The ranges
that can reach most are scored first, which gives a score that k texts have; after that only ranges
that can still reach it are read. The k best are exact. Lists go to the task that scores their ranges,
which passes on the k best of its texts per query and what equals the last of them.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import text as X
from shelfmark.operators.numbering import numbered
from shelfmark.operators.ranking import top_k
from shelfmark.plans.search import SCORE_DECIMALS, best_first
from shelfmark.session import materialised, shared_path

BLOCK_DOCS = 4096
BUCKETS = 64
# Ranges per query that are scored before others are given up.
FIRST_RANGES = 2
# Bounds are sums of doubles in another order than scores; the bound is taken this much higher.
ROUNDING = 1e-9
# A range ends early when its texts hold so many terms, so that a task holds few of them.
RANGE_TERMS = 4_000_000
# Rows of lists that a task unpacks at a time.
UNPACKED_ROWS = 16_384
# Up to this number, rows of weights go to every task; lists meet more in a shuffle.
BROADCAST_WEIGHTS = 100_000
# One task scores the ranges of so many texts for so many queries; parts of scores it adds up at a time.
SPAN_DOCS = 4096
SPAN_QUERIES = 2048
BLOCK_PARTS = 1_000_000


@dataclass(frozen=True)
class Postings:
    """documents (doc_no, dataset_id, doc_len); lists (bucket, term, range, n, max_gain, offsets, tfs, lens);
    terms (bucket, term, df); totals (n_docs, avg_len)."""

    documents: DataFrame
    lists: DataFrame
    terms: DataFrame
    totals: DataFrame
    block_docs: int
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def _gain(tf: np.ndarray, doc_len: np.ndarray, avg_len: float) -> np.ndarray:
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * doc_len / avg_len))


def term_counts(text: Column | str) -> Column:
    """The terms of a text with their counts: array<struct<term, tf>>, as the runs of its sorted terms.

    Transforms of one-element arrays bind a name, so that no array is made twice.
    """

    def runs(terms: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(terms)), lambda i: (i == 1) | (F.get(terms, i - 1) != F.get(terms, i - 2)))

        def run(starts: Column) -> Column:
            end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(terms) + 1)
            return F.transform(starts, lambda at, i: F.struct(F.get(terms, at - 1).alias("term"), (end(i) - at).alias("tf")))

        return F.transform(F.array(begins), run)

    ordered = F.array(F.sort_array(X.terms(text)))
    return F.flatten(F.flatten(F.transform(ordered, lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.lit(None)))))


_PACKS = "packs array<struct<bucket:int,terms:string,ns:binary,offsets:binary,tfs:binary>>"


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def _numbers(held: pa.BinaryScalar, n: int) -> np.ndarray:
    held = held.as_buffer()
    return np.frombuffer(held, dtype=f"u{held.size // n}").astype(np.int32)


def _packed(parts: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    """The lists of one range (dataset_id, counts): per bucket the terms, how many texts hold each, and these texts and counts."""
    counts = pa.concat_arrays([p.column("counts") for p in parts])
    sizes = pc.fill_null(pc.list_value_length(counts), 0).to_numpy()
    flat = counts.flatten()
    terms, tfs = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy()
    texts = np.repeat(np.arange(len(sizes)), sizes)
    names, codes = terms.dictionary, terms.indices.to_numpy()
    bucket = np.fromiter((zlib.crc32(t) % buckets for t in names.cast(pa.binary()).to_pylist()), np.int64, len(names))
    ranked = np.argsort(bucket, kind="stable")
    place = np.empty_like(ranked)
    place[ranked] = np.arange(len(ranked))
    order = np.lexsort((texts, place[codes]))
    texts, counted = texts[order], tfs[order]
    ns = np.bincount(place[codes], minlength=len(names))
    ends = np.concatenate(([0], np.cumsum(ns)))
    names, bucket = names.take(pa.array(ranked)), bucket[ranked]
    found, begins = np.unique(bucket, return_index=True)
    packs = []
    for number, a, b in zip(found.tolist(), begins, [*begins[1:], len(names)]):
        at = slice(ends[a], ends[b])
        packs.append(
            {"bucket": number, "terms": " ".join(names[a:b].to_pylist()), "ns": _bytes(ns[a:b]), "offsets": _bytes(texts[at]), "tfs": _bytes(counted[at])}
        )
    pack = pa.struct([("bucket", pa.int32()), ("terms", pa.string()), ("ns", pa.binary()), ("offsets", pa.binary()), ("tfs", pa.binary())])
    lens = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=tfs, minlength=len(sizes)).astype(np.int32)
    ids = pa.concat_arrays([p.column("dataset_id") for p in parts]).to_pylist()
    columns = [pa.array([ids], pa.list_(pa.string())), pa.array([lens], pa.list_(pa.int32())), pa.array([packs], pa.list_(pack))]
    return pa.RecordBatch.from_arrays(columns, ["ids", "lens", "packs"])


def _cut_to_ranges(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[list[pa.RecordBatch]]:
    """Texts in the order of their task, in ranges of block_docs and of RANGE_TERMS, or one text."""
    parts, texts, terms = [], 0, 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("counts")), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = min(start + block_docs - texts, int(np.searchsorted(upto, before + RANGE_TERMS - terms, side="right")))
            stop = max(stop, start + 1) if not texts else stop
            if stop > start:
                parts.append(batch.slice(start, stop - start))
                texts, terms = texts + stop - start, terms + int(upto[stop - 1] - before)
            if texts == block_docs or stop < batch.num_rows:
                yield parts
                parts, texts, terms = [], 0, 0
            start = stop
    if parts:
        yield parts


def _unpacked(rows: list[dict[str, pa.Scalar]], avg_len: float) -> pa.RecordBatch:
    """Rows of lists out of packs (bucket, range, lens, terms, ns, offsets, tfs)."""
    terms = [r["terms"].as_py().split(" ") for r in rows]
    sizes = [len(t) for t in terms]
    ns = [_numbers(r["ns"], n) for r, n in zip(rows, sizes)]
    entries = [int(n.sum()) for n in ns]
    offsets = [_numbers(r["offsets"], n) for r, n in zip(rows, entries)]
    lens = np.concatenate([r["lens"].values.to_numpy()[o] for r, o in zip(rows, offsets)])
    tfs = np.concatenate([_numbers(r["tfs"], n) for r, n in zip(rows, entries)])
    ns = np.concatenate(ns)
    begins = np.concatenate(([0], np.cumsum(ns))).astype(np.int32)
    gains = np.maximum.reduceat(_gain(tfs, lens, avg_len), begins[:-1])
    lists = [pa.ListArray.from_arrays(pa.array(begins), pa.array(values, pa.int32())) for values in (np.concatenate(offsets), tfs, lens)]
    per_row = lambda name, kind: pa.array(np.repeat([r[name].as_py() for r in rows], sizes), kind)
    columns = [pa.array([t for some in terms for t in some], pa.string()), per_row("range", pa.int64()), pa.array(ns, pa.int32()), pa.array(gains), *lists, per_row("bucket", pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", "n", "max_gain", "offsets", "tfs", "lens", "bucket"])


def build_postings(corpus: DataFrame, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS, folder: str | None = None) -> Postings:
    """The index of a corpus (dataset_id, content), kept in ``folder`` or a new one in the shared folder.

    One pass over the texts, which makes the lists of a range in the task that reads its texts. Lists of
    a range and bucket are packed to one row, and only those rows are shuffled, once, by bucket.
    """
    spark = corpus.sparkSession
    folder = folder or shared_path(spark, "postings")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _cut_to_ranges(batches, block_docs):
            yield _packed(parts, buckets)

    texts = corpus.select("dataset_id", term_counts("content").alias("counts"))
    ranges = numbered(texts.mapInArrow(pack, f"ids array<string>, lens array<int>, {_PACKS}"), "range")
    each = ranges.select("range", F.posexplode(F.arrays_zip("ids", "lens")).alias("offset", "d"))
    doc_no = (F.col("range") * block_docs + F.col("offset")).alias("doc_no")
    each.select(doc_no, F.col("d.ids").alias("dataset_id"), F.col("d.lens").alias("doc_len")).write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    documents.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")).coalesce(1).write.parquet(f"{folder}/totals")
    avg_len = spark.read.parquet(f"{folder}/totals").first()["avg_len"] or 1.0

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at in range(batch.num_rows):
                rows.append({c: batch.column(c)[at] for c in batch.schema.names})
                held += rows[-1]["terms"].as_py().count(" ") + 1
                if held >= UNPACKED_ROWS:
                    yield _unpacked(rows, avg_len)
                    rows, held = [], 0
            if rows:
                yield _unpacked(rows, avg_len)

    packs = ranges.select("range", "lens", F.explode("packs").alias("p")).select("range", "lens", "p.*")
    order = ("bucket", "term", "range")
    packs.hint("rebalance", "bucket").mapInArrow(unpack, _LISTS).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/lists")
    lists = spark.read.schema(_LISTS).parquet(f"{folder}/lists")
    terms = lists.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
    return load_postings(spark, folder, block_docs, buckets)


_LISTS = "term string, range bigint, n int, max_gain double, offsets array<int>, tfs array<int>, lens array<int>, bucket int"


def load_postings(spark: SparkSession, folder: str, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> Postings:
    """An index that build_postings has left in a folder."""
    return Postings(
        spark.read.schema("doc_no bigint, dataset_id string, doc_len int").parquet(f"{folder}/documents"),
        spark.read.schema(_LISTS).parquet(f"{folder}/lists"),
        spark.read.schema("term string, df bigint, bucket int").parquet(f"{folder}/terms"),
        spark.read.parquet(f"{folder}/totals"),
        block_docs,
        buckets,
    )


def _sent(rows: DataFrame) -> DataFrame:
    """Rows in the shared folder that go to every task in a join if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS else rows


def _weights(index: Postings, queries: DataFrame) -> DataFrame:
    """(query_id, bucket, term, weight): what a gain of 1 of a term counts for a query."""
    asked = queries.select("query_id", F.explode(X.terms("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = materialised(asked.withColumn("bucket", _bucket(F.col("term"), index.buckets)), "query-terms")
    n = index.totals.select("n_docs").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = index.terms.join(_sent(asked), ["bucket", "term"])
    return materialised(found.select("query_id", "bucket", "term", (idf * F.col("times")).alias("weight")), "query-weights")


def range_bounds(index: Postings, weights: DataFrame) -> DataFrame:
    """(query_id, range, bound): what a text of a range can reach at most, from the maxima alone."""
    heads = index.lists.select("bucket", "term", "range", "max_gain").join(_sent(weights), ["bucket", "term"])
    return heads.groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("max_gain")).alias("bound"))


def _best_or_equal(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each row number and of all that equal the last of them, by row and score."""
    order = np.lexsort((-scores, rows))
    rows, scores = rows[order], scores[order]
    begins = np.searchsorted(rows, rows, side="left")
    ends = np.searchsorted(rows, rows, side="right")
    return order[scores >= scores[np.minimum(begins + k, ends) - 1]]


def _add_up(lists: dict[str, np.ndarray], asked: dict[str, np.ndarray], queries: int, width: int) -> np.ndarray:
    """Scores of the texts of a range: a row per query, 0 for texts without a term of it.

    lists: term (a code), begin and n of its entries, of which offset and gain are given; asked: by term, begin and n of its
    places among query and weight.
    """
    total = np.zeros(queries * width)
    # A pair is a list and a query that asks for it; its parts are the entries of the list.
    times = asked["n"][lists["term"]]
    lists_of = np.repeat(np.arange(len(times)), times)
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(asked["begin"][lists["term"]], times)
    query, weight = asked["query"][at], asked["weight"][at]
    wanted = query >= 0
    lists_of, query, weight = lists_of[wanted], query[wanted], weight[wanted]
    sizes = lists["n"][lists_of]
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BLOCK_PARTS, side="right")))
        some = slice(start, stop)
        n = sizes[some]
        entry = np.arange(n.sum()) + np.repeat(lists["begin"][lists_of[some]] - (np.cumsum(n) - n), n)
        total += np.bincount(np.repeat(query[some] * width, n) + lists["offset"][entry], weights=np.repeat(weight[some], n) * lists["gain"][entry], minlength=total.size)
        start = stop
    return total.reshape(queries, width)


def _score_span(held: pa.Table, asked: pa.Table, k: int, block_docs: int, avg_len: float) -> pa.Table:
    """The best texts, and equal ones, of lists (range, term, offsets, tfs, lens) for queries (query_id, ranges, least, terms, weights)."""
    found = [], [], []
    held, asked = held.sort_by("range").combine_chunks(), asked.combine_chunks()
    terms, weights = asked.column("terms").combine_chunks(), asked.column("weights").combine_chunks()
    names = pc.unique(terms.flatten())
    held = held.filter(pc.is_in(held.column("term"), value_set=names)).combine_chunks()
    if held.num_rows:
        codes, of_list = (pc.index_in(t, value_set=names).to_numpy(zero_copy_only=False) for t in (terms.flatten(), held.column("term").combine_chunks()))
        order = np.argsort(codes, kind="stable")
        query, weight = np.asarray(pc.list_parent_indices(terms))[order], np.asarray(weights.flatten())[order]
        times = np.bincount(codes, minlength=len(names))
        least = pc.fill_null(asked.column("least"), -np.inf).to_numpy()
        chosen = asked.column("ranges").combine_chunks()
        wanted_by, wanted = np.asarray(pc.list_parent_indices(chosen)), np.asarray(chosen.flatten())
        offsets, tfs, lens = (held.column(c).combine_chunks() for c in ("offsets", "tfs", "lens"))
        ns = pc.list_value_length(offsets).to_numpy()
        ends = np.cumsum(ns)
        offset = np.asarray(offsets.flatten())
        gain = _gain(np.asarray(tfs.flatten()), np.asarray(lens.flatten()), avg_len)
        ranges = held.column("range").to_numpy()
        for number in np.unique(wanted).tolist():
            a, b = np.searchsorted(ranges, [number, number + 1])
            if a == b:
                continue
            at = slice(ends[a] - ns[a], ends[b - 1])
            lists = {"term": of_list[a:b], "n": ns[a:b], "begin": ends[a:b] - ns[a:b] - at.start, "offset": offset[at], "gain": gain[at]}
            width = int(lists["offset"].max()) + 1
            askers = wanted_by[wanted == number]
            step = max(1, 4 * BLOCK_PARTS // width)
            for some in (askers[i : i + step] for i in range(0, len(askers), step)):
                place = np.full(asked.num_rows, -1)
                place[some] = np.arange(len(some))
                scores = _add_up(lists, {"n": times, "begin": np.cumsum(times) - times, "query": place[query], "weight": weight}, len(some), width)
                rounded = np.round(scores, SCORE_DECIMALS)
                rows, texts = np.nonzero((scores > 0) & (rounded >= least[some][:, None]))
                values = rounded[rows, texts]
                kept = _best_or_equal(rows, values, k)
                for out, more in zip(found, (some[rows[kept]], number * block_docs + texts[kept], values[kept])):
                    out.append(more)
    if not found[0]:
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    rows, texts, values = map(np.concatenate, found)
    kept = _best_or_equal(rows, values, k)
    ids = asked.column("query_id").combine_chunks().take(pa.array(rows[kept], pa.int64()))
    return pa.table({"query_id": ids, "doc_no": pa.array(texts[kept], pa.int64()), "score": pa.array(values[kept], pa.float64())})


def _scores(index: Postings, weights: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_no, score) of the texts of chosen ranges (query_id, range, perhaps least): the k best per query and all that equal the last of them, at least.

    A task gets the lists of neighbouring ranges and the queries that chose some of them, cut into bounded blocks.
    """
    avg_len = index.totals.first()["avg_len"] or 1.0
    block_docs = index.block_docs
    blocks = max(1, -(-weights.select("query_id").distinct().count() // SPAN_QUERIES))
    span = F.floor(F.col("range") / max(1, SPAN_DOCS // block_docs)).alias("span")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    least = F.max("least") if "least" in chosen.columns else F.lit(None).cast("double")
    asked = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    right = chosen.groupBy("query_id", span).agg(F.collect_list("range").alias("ranges"), least.alias("least")).join(asked, "query_id")
    right = right.select("query_id", "ranges", "least", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"), "span", block)
    lists = index.lists.join(_sent(materialised(chosen.select("range").distinct(), "chosen-ranges")), "range", "left_semi")
    lists = lists.join(_sent(materialised(weights.select("bucket", "term", block).distinct(), "asked-terms")), ["bucket", "term"])
    left = lists.select("range", "term", "offsets", "tfs", "lens", span, "block")

    def score(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _score_span(held, asked, k, block_docs, avg_len)

    return left.groupBy("span", "block").cogroup(right.groupBy("span", "block")).applyInArrow(score, "query_id string, doc_no bigint, score double")


def choose_ranges(index: Postings, weights: DataFrame, k: int, first_ranges: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds, best of the first ranges, further ranges): all but these ranges cannot hold one of the k best."""
    bounds = materialised(range_bounds(index, weights), "range-bounds")
    first = materialised(top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("range")], first_ranges).select("query_id", "range"), "first-ranges")
    scored = materialised(_scores(index, weights, first, k), "first-scores")
    kth = top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_no")], k).filter(F.col("rank") == k)
    kth = kth.select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["query_id", "range"], "left_anti").join(kth, "query_id", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") + ROUNDING >= F.col("least")))
    return bounds, scored, materialised(rest.select("query_id", "range", "least"), "further-ranges")


def search_postings(index: Postings, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, dataset_id, score): the k best datasets of every query (query_id, query) by BM25.

    Queries are rows, of any number: none is sent to the driver but few weights, for a join. Equal scores are ranked by dataset_id.
    """
    weights = _weights(index, queries)
    _, first, further = choose_ranges(index, weights, k)
    hits = materialised(first.unionByName(_scores(index, weights, further, k)), "hits")
    # Only texts that no k texts beat need their ids, on which ties are decided.
    kth = top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_no")], k).groupBy("query_id").agg(F.min("score").alias("least"), F.max("rank").alias("n"))
    kept = hits.join(kth, "query_id").filter((F.col("n") < k) | (F.col("score") >= F.col("least")))
    named = kept.join(index.documents.select("doc_no", "dataset_id"), "doc_no")
    return top_k(named, ["query_id"], best_first(), k).select("query_id", "rank", "dataset_id", "score")
