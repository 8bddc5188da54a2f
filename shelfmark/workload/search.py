"""Keyword search queries."""

from pyspark.sql import functions as F

from shelfmark import views as V
from shelfmark.functions import text as X
from shelfmark.operators.catalog import Filters, metadata, search_corpus
from shelfmark.operators.keyed import lookup
from shelfmark.operators.numbering import numbered
from shelfmark.plans import postings as P
from shelfmark.plans import search as S
from shelfmark.plans import signatures as G
from shelfmark.workload.registry import ARTIFACTS, DATASETS, SIGNALS, TERM, query

QUERY = "the with the text"
RARE_QUERY = "ention das tion"
FILTERS = Filters(modality="EX", license_class="mit", size_class="1K<n<10K", language="EN")

_SCORE = " + ".join(f"CAST(contains(content, '{t}') AS INTEGER)" for t in QUERY.split())
_WHY = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN contains(content, '{t}') THEN '{t}' END" for t in QUERY.split()) + ")"
_SCORED = f"scored AS (SELECT id, {_SCORE} AS score, {_WHY} AS why FROM corpus)"
_HIT = """
SELECT d.id, title, description, readme_text, license_class, access_class, size_class, modalities, languages, tags,
       why, f.dataset_id IS NOT NULL AS has_schema, CAST(downloads AS BIGINT) AS downloads,
       CAST(likes AS BIGINT) AS likes, CAST(score AS DOUBLE) AS score
FROM scored s JOIN datasets d ON d.id = s.id LEFT JOIN fresh f ON f.dataset_id = d.id
WHERE score > 0"""
_HEAD = f"WITH {DATASETS}, {ARTIFACTS}, {_SCORED}"
_FILTER_SQL = """ AND modalities LIKE '%ex%' AND license_class = 'mit' AND size_class = '1K<n<10K'
 AND languages LIKE '%en%'"""


def _flat(hits):
    empty = F.size("modalities") == 0
    return hits.select(
        "id", "title", "description", "readme_text", "license_class", "access_class", "size_class",
        F.when(~empty, X.json_text("modalities")).alias("modalities"),
        X.json_text("languages").alias("languages"),
        X.json_text("tags").alias("tags"),
        F.array_join("why", " ").alias("why"),
        "has_schema", "downloads", "likes", "score",
    )


def _tables(spark, folder):
    datasets = V.datasets(spark, folder)
    return search_corpus(datasets), datasets, V.artifacts(spark, folder)


@query("search_tokens", f"{_HEAD} {_HIT} ORDER BY score DESC, d.id LIMIT 30")
def search_tokens(spark, folder):
    return _flat(S.search_tokens(*_tables(spark, folder), QUERY))


@query("search_tokens_filtered", f"{_HEAD} {_HIT} {_FILTER_SQL} ORDER BY score DESC, d.id LIMIT 30")
def search_tokens_filtered(spark, folder):
    return _flat(S.search_tokens(*_tables(spark, folder), QUERY, FILTERS))


@query("search_page2", f"{_HEAD} {_HIT} ORDER BY score DESC, d.id LIMIT 30 OFFSET 30")
def search_page2(spark, folder):
    return _flat(S.search_tokens(*_tables(spark, folder), QUERY, offset=30))


@query("search_total", f"WITH {DATASETS}, {_SCORED} SELECT count(*) AS total FROM scored WHERE score > 0")
def search_total(spark, folder):
    corpus, datasets, _ = _tables(spark, folder)
    return S.search_total(corpus, datasets, QUERY)


@query("search_why", f"WITH {DATASETS}, {_SCORED} SELECT id, why FROM scored WHERE score > 0")
def search_why(spark, folder):
    corpus, _, _ = _tables(spark, folder)
    tokens = S.query_tokens(QUERY)
    found = corpus.select(F.col("dataset_id").alias("id"), X.tokens_found(F.col("content"), tokens).alias("why"))
    return found.filter(F.size("why") > 0).select("id", F.array_join("why", " ").alias("why"))


@query("search_corpus", f"WITH {DATASETS} SELECT id AS dataset_id, content FROM corpus")
def corpus_rows(spark, folder):
    return search_corpus(V.datasets(spark, folder))


_BENCH_TOKENS = """
asked AS (
  SELECT 'B' || item_id AS query_id, unnest(regexp_extract_all(lower(text), '[^ \\n]+')) AS token FROM benchmark),
tokens AS (SELECT query_id, token, count(*) AS times FROM asked GROUP BY ALL),
found AS (
  SELECT id, token FROM corpus JOIN (SELECT DISTINCT token FROM tokens) ON contains(content, token)),
scored AS (SELECT query_id, id, CAST(sum(times) AS BIGINT) AS score FROM found JOIN tokens USING (token) GROUP BY ALL)"""
_BATCH_TOP = """
SELECT query_id, rank, id AS dataset_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)
WHERE rank <= 10"""


def _questions(spark, folder):
    return V.eval_queries(spark, folder).select(F.col("id").alias("query_id"), "query")


@query("search_tokens_batch", f"WITH {DATASETS}, {_BENCH_TOKENS} {_BATCH_TOP}")
def search_tokens_batch(spark, folder):
    corpus, datasets, _ = _tables(spark, folder)
    return S.search_tokens_batch(corpus, datasets, _questions(spark, folder), 10)


@query(
    "search_blank_batch",
    f"""WITH {DATASETS}, {_BENCH_TOKENS.replace("FROM benchmark", "FROM benchmark WHERE item_id % 2 = 1")}
    {_BATCH_TOP}""",
)
def search_blank_batch(spark, folder):
    """A batch in which every other query is white space: those have no hits."""
    corpus, datasets, _ = _tables(spark, folder)
    blank = F.when(F.substring("query_id", 2, 9).cast("int") % 2 == 1, F.col("query")).otherwise(" \n ")
    return S.search_tokens_batch(corpus, datasets, _questions(spark, folder).withColumn("query", blank), 10)


@query(
    "search_sources_batch",
    f"""WITH {DATASETS},
    asked AS (SELECT DISTINCT source AS query_id, source AS token FROM documents
              UNION ALL SELECT DISTINCT source, lang FROM documents),
    scored AS (SELECT query_id, id, CAST(count(*) AS BIGINT) AS score
               FROM corpus JOIN asked ON contains(content, token) GROUP BY ALL)
    {_BATCH_TOP}""",
)
def search_sources_batch(spark, folder):
    """One query per source, out of its name and its languages."""
    corpus, datasets, _ = _tables(spark, folder)
    asked = V.table(spark, folder, "documents").groupBy(F.col("source").alias("query_id")).agg(
        F.concat_ws(" ", F.col("source"), F.array_join(F.collect_set("lang"), " ")).alias("query")
    )
    return S.search_tokens_batch(corpus, datasets, asked, 10)


_POSTINGS = f"""
terms AS (SELECT id, unnest(regexp_extract_all(content, '{TERM}')) AS term FROM corpus),
lens AS (SELECT id, len(regexp_extract_all(content, '{TERM}')) AS doc_len FROM corpus),
postings AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
totals AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens)"""


def _bm25(asked: str) -> str:
    return f"""
{asked},
scored AS (
  SELECT query_id, id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * tf * (1.2 + 1)
               / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 10) AS score
  FROM asked JOIN dfs USING (term) JOIN postings USING (term) JOIN lens USING (id), totals
  GROUP BY query_id, id)"""


_BENCH_TERMS = f"""asked AS (
  SELECT query_id, term, count(*) AS times FROM (
    SELECT 'B' || item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM benchmark)
  GROUP BY ALL)"""
_BATCH_SHOWN = f"SELECT query_id, rank, dataset_id, round(score, 6) AS score FROM ({_BATCH_TOP})"
_ONE_ASKED = "asked AS (SELECT '' AS query_id, unnest(['ention', 'das', 'tion']) AS term, 1 AS times)"


@query("bm25_corpus_stats", f"""WITH {DATASETS}, {_POSTINGS}
SELECT term, df, n AS n_docs, round(avg_len, 6) AS avg_len FROM dfs, totals""")
def bm25_corpus_stats(spark, folder):
    index = S.build_term_index(_tables(spark, folder)[0])
    return index.terms.select(
        "term", "df", index.totals.select("n_docs").scalar().alias("n_docs"),
        F.round(index.totals.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@query("search_bm25", f"""WITH {DATASETS}, {ARTIFACTS}, {_POSTINGS}, {_bm25(_ONE_ASKED)}
SELECT s.id, round(score, 6) AS score, f.dataset_id IS NOT NULL AS has_schema, title
FROM scored s JOIN datasets d ON d.id = s.id
LEFT JOIN fresh f ON f.dataset_id = s.id ORDER BY s.score DESC, s.id LIMIT 30""")
def search_bm25(spark, folder):
    corpus, datasets, artifacts = _tables(spark, folder)
    asked = spark.createDataFrame([("", RARE_QUERY)], "query_id string, query string")
    hits = S.search_bm25(S.build_term_index(corpus, asked), datasets, artifacts, RARE_QUERY)
    return hits.select("id", F.round("score", 6).alias("score"), "has_schema", "title")


# Beginnings of words of every text, which are no words of their own.
_PARTS = "ourc fro"


@query(
    "search_bm25_fallback",
    f"""WITH {DATASETS}, {ARTIFACTS}, {_POSTINGS},
    {_bm25("asked AS (SELECT '' AS query_id, unnest(['ourc', 'fro']) AS term, 1 AS times)").replace("scored AS", "by_term AS")},
    by_token AS (SELECT id, CAST(contains(content, 'ourc') AS INTEGER) + CAST(contains(content, 'fro') AS INTEGER) AS score FROM corpus),
    scored AS (SELECT id, score FROM by_term UNION ALL
               SELECT id, score FROM by_token WHERE score > 0 AND (SELECT count(*) FROM by_term) = 0)
    SELECT s.id, round(CAST(score AS DOUBLE), 6) AS score, f.dataset_id IS NOT NULL AS has_schema, title
    FROM scored s JOIN datasets d ON d.id = s.id LEFT JOIN fresh f ON f.dataset_id = s.id
    ORDER BY s.score DESC, s.id LIMIT 30""",
)
def search_bm25_fallback(spark, folder):
    """Token hits, as no text holds a term of the query."""
    corpus, datasets, artifacts = _tables(spark, folder)
    asked = spark.createDataFrame([("", _PARTS)], "query_id string, query string")
    hits = S.search_bm25(S.build_term_index(corpus, asked), datasets, artifacts, _PARTS, fall_back=corpus)
    return hits.select("id", F.round("score", 6).alias("score"), "has_schema", "title")


def _shown(hits):
    return hits.withColumn("score", F.round("score", 6))


@query("search_bm25_batch", f"WITH {DATASETS}, {_POSTINGS}, {_bm25(_BENCH_TERMS)} {_BATCH_SHOWN}")
def search_bm25_batch(spark, folder):
    corpus, datasets, _ = _tables(spark, folder)
    asked = _questions(spark, folder)
    return _shown(S.search_bm25_batch(S.build_term_index(corpus, asked), datasets, asked, 10))


@query(
    "search_bm25_filtered",
    f"""WITH {DATASETS}, {_POSTINGS}, {_bm25(_BENCH_TERMS).replace("scored AS", "unfiltered AS")},
    scored AS (SELECT u.* FROM unfiltered u JOIN datasets d ON d.id = u.id WHERE true {_FILTER_SQL})
    {_BATCH_SHOWN}""",
)
def search_bm25_filtered(spark, folder):
    """The index carries what filters look at, so that nothing is joined."""
    corpus = search_corpus(V.datasets(spark, folder), with_filters=True)
    asked = _questions(spark, folder)
    return _shown(S.search_bm25_batch(S.build_term_index(corpus, asked), None, asked, 10, FILTERS))


@query("search_bm25_pruned", f"WITH {DATASETS}, {_POSTINGS}, {_bm25(_BENCH_TERMS)} {_BATCH_SHOWN}")
def search_bm25_pruned(spark, folder):
    """The same hits from lists of terms with block maxima: only ranges of texts that can hold one are read."""
    index = P.build_postings(_tables(spark, folder)[0], block_docs=256)
    return _shown(P.search_postings(index, _questions(spark, folder), 10))


@query(
    "dense_numbering",
    """WITH rows AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), whole AS (SELECT count(*) AS n FROM documents)
    SELECT source, rows.n, 0 AS lowest, whole.n - 1 AS highest, whole.n AS numbers FROM rows, whole""",
)
def dense_numbering(spark, folder):
    """Each text has a number of its own from 0 to n - 1."""
    rows = numbered(V.table(spark, folder, "documents").select("doc_id", "source"))
    whole = rows.agg(F.min("number").cast("int").alias("lowest"), F.max("number").alias("highest"), F.countDistinct("number").alias("numbers"))
    return rows.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(whole))


@query("lookup_datasets", f"""WITH {DATASETS}, {SIGNALS}
SELECT id, title, description, license_class, access_class, size_class, coalesce(modalities, '[]') AS modalities,
       languages, tags FROM datasets WHERE id IN (SELECT dataset_id FROM signals)""")
def lookup_datasets(spark, folder):
    """Descriptions of all datasets that were used."""
    used = V.signals(spark, folder).select(F.col("dataset_id").alias("id"))
    rows = metadata(lookup(V.datasets(spark, folder), used, ["id"]))
    lists = ["modalities", "languages", "tags"]
    return rows.select(*[c for c in rows.columns if c not in lists], *[X.json_text(c).alias(c) for c in lists])


SIGNED_QUERY = "src1 ention-zz erwhhaes \u00e9t"
_SIGNED_SCORE = " + ".join(f"CAST(contains(content, '{t}') AS INTEGER)" for t in SIGNED_QUERY.split())


@query("search_signed", f"""WITH {DATASETS} SELECT * FROM (SELECT id AS dataset_id, {_SIGNED_SCORE} AS score FROM corpus) WHERE score > 0""")
def search_signed(spark, folder):
    """All texts that hold a token, from the blocks whose signature fits; one token is too short for a trigram."""
    corpus, _, _ = _tables(spark, folder)
    return G.signed_matches(G.build_signatures(corpus), SIGNED_QUERY)


_RARE_SCORE = " + ".join(f"CAST(contains(content, '{t}') AS INTEGER)" for t in RARE_QUERY.split())


@query("search_signed_rare", f"""WITH {DATASETS}, {ARTIFACTS}
SELECT d.id, title, has_schema, CAST(score AS DOUBLE) AS score
FROM (SELECT id, {_RARE_SCORE} AS score FROM corpus) JOIN datasets d USING (id)
LEFT JOIN (SELECT dataset_id, true AS has_schema FROM fresh) f ON f.dataset_id = d.id
WHERE score > 0 ORDER BY score DESC, d.id LIMIT 30""".replace("title, has_schema,", "title, coalesce(has_schema, false) AS has_schema,"))
def search_signed_rare(spark, folder):
    """A page of hits through the signatures."""
    corpus, datasets, artifacts = _tables(spark, folder)
    return G.search_signed(G.build_signatures(corpus), datasets, artifacts, RARE_QUERY).select("id", "title", "has_schema", "score")
