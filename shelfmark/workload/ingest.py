"""Import, upsert and change-detection queries."""

from pyspark.sql import functions as F

from shelfmark import views as V
from shelfmark.constants import LINE_END
from shelfmark.functions import json as J
from shelfmark.functions import text as X
from shelfmark.functions.times import iso_format
from shelfmark.operators import keyed as K
from shelfmark.plans import ingest as I
from shelfmark.schemas import conform
from shelfmark.workload.registry import ARTIFACTS, AS_OF, DATASETS, JOBS, NOT_SPACE, query

_LICENSE = "case lang when 'en' then 'mit' when 'fr' then 'apache-2.0' when 'de' then 'cc-by-nc-4.0' end"
_TOKENS = f"len(regexp_extract_all(text, '{NOT_SPACE}'))"


def jsonl_lines(spark, folder):
    """Documents as catalog lines: four sources give rows that must be rejected."""
    documents = V.table(spark, folder, "documents").selectExpr(
        "doc_id", "source",
        """to_json(named_struct(
          'id', concat('org/doc-', doc_id), 'name', case when lang <> 'fr' then concat(source, '-set') end,
          'pretty_name', case when lang = 'en' then concat('Set ', doc_id) end, 'description', text,
          'license', """ + _LICENSE + """, 'private', source = 'src0', 'gated', case when source = 'src7' then 'auto' end,
          'disabled', case when source = 'src5' then true end, 'tags', array(lang, source),
          'task_categories', case lang when 'en' then array('text-classification', 'image-to-text')
              when 'fr' then array('unknown-task') when 'de' then array('tabular-to-text', 'text-generation') end,
          'language', lang, 'size_categories', case when lang <> 'de' then array('n<1K') end,
          'downloads', n_chars, 'likes', case when lang <> 'de' then doc_id end,
          'last_modified', case when lang <> 'es' then '2024-01-31T12:00:00Z' else 'yesterday' end,
          'sha', md5(text),
          'dataset_info', case when lang = 'es' then named_struct('features', named_struct('text', 'string')) end))
        as line""",
        "to_json(named_struct('id', doc_id)) as bare",
    )
    return documents.select(
        F.struct("doc_id").alias("seq"),
        F.expr("case source when 'src3' then bare when 'src4' then concat('{', line) "
               "when 'src6' then concat('[', line, ']') else line end").alias("value"),
    )


_REASON = """CASE source WHEN 'src3' THEN 'id_not_text' WHEN 'src4' THEN 'malformed' WHEN 'src5' THEN 'disabled'
  WHEN 'src6' THEN 'not_object' END"""


@query("ingest_rejects", f"SELECT doc_id, {_REASON} AS reject_reason FROM documents WHERE {_REASON} IS NOT NULL")
def ingest_rejects(spark, folder):
    rejects = I.ingest_jsonl(jsonl_lines(spark, folder), as_of=V.CATALOG_AS_OF).rejects
    return rejects.select("seq.doc_id", "reject_reason")


@query("ingest_counters", f"""SELECT coalesce({_REASON}, 'loaded') AS outcome, count(*) AS "rows" FROM documents GROUP BY 1""")
def ingest_counters(spark, folder):
    return I.ingest_jsonl(jsonl_lines(spark, folder), as_of=V.CATALOG_AS_OF).counters()


def _flat_records(records):
    return records.select(
        "id", "source", "ns_local_id", "title", "description", "readme_text", "license_class", "access_class",
        "size_class", "readme_sha256", "fingerprint", "readme_tokens", "readme_score", "schema_hint",
        *[X.json_text(c).alias(c) for c in ("tags", "modalities", "languages", "eligibility_flags")],
        F.unix_micros("last_seen_lm").alias("last_seen_lm"),
        F.unix_micros("indexed_at").alias("indexed_at"),
        *[F.try_element_at("quality_signals", F.lit(c)).alias(c) for c in ("downloads", "likes")],
    )


_JSONL_RECORDS = f"""
SELECT 'org/doc-' || doc_id AS id, 'hf' AS source,
       CASE WHEN lang <> 'fr' THEN source || '-set' ELSE 'doc-' || doc_id END AS ns_local_id,
       CASE WHEN lang = 'en' THEN 'Set ' || doc_id WHEN lang = 'fr' THEN 'doc-' || doc_id ELSE source || '-set' END AS title,
       text AS description, CAST(NULL AS VARCHAR) AS readme_text, {_LICENSE} AS license_class,
       CASE WHEN source = 'src0' THEN 'private' ELSE 'public' END AS access_class,
       CASE WHEN lang <> 'de' THEN 'n<1K' END AS size_class, CAST(NULL AS VARCHAR) AS readme_sha256,
       'v1jsonl:org/doc-' || doc_id || ':' || md5(text) AS fingerprint, CAST({_TOKENS} AS INTEGER) AS readme_tokens,
       least({_TOKENS} / 50.0, 1.0)::DOUBLE AS readme_score,
       CASE WHEN lang = 'es' THEN '{{"text":"string"}}' END AS schema_hint,
       '["' || lang || '", "' || source || '"]' AS tags,
       CASE lang WHEN 'en' THEN '["text", "image"]' WHEN 'de' THEN '["tabular", "text"]' END AS modalities,
       '["' || lang || '"]' AS languages, CASE WHEN source = 'src7' THEN '["gated"]' END AS eligibility_flags,
       CASE WHEN lang <> 'es' THEN epoch_us(TIMESTAMP '2024-01-31 12:00:00') END AS last_seen_lm,
       epoch_us({AS_OF}) AS indexed_at, CAST(n_chars AS VARCHAR) AS downloads,
       CASE WHEN lang <> 'de' THEN CAST(doc_id AS VARCHAR) END AS likes
FROM documents WHERE {_REASON} IS NULL"""


@query("canonical_projection", _JSONL_RECORDS)
def canonical_projection(spark, folder):
    """Catalog records of all accepted lines."""
    return _flat_records(I.ingest_jsonl(jsonl_lines(spark, folder), as_of=V.CATALOG_AS_OF).records)


def parquet_rows(spark, folder):
    documents = V.table(spark, folder, "documents")
    rows = documents.selectExpr(
        "named_struct('doc_id', doc_id) as seq", "concat(' org/doc-', doc_id) as id",
        "case when lang <> 'fr' then concat('my_', source, '-set') else 'nan' end as name",
        "case when lang <> 'es' then concat(' ', lang, '-1.0 ') else 'nan' end as license",
        "md5(text) as readme_sha256", "case when source = 'src2' then 'boom' else ' ' end as enrich_error",
        "source = 'src0' as is_private", "source = 'src7' as is_gated",
        "array(concat('lang:', lang), null, case when lang <> 'de' then concat('size_categories:', source, ':x') end) as tags",
        "case lang when 'en' then array('image-captioning', null, 'fill-mask') when 'de' then array() end as task_categories",
        "case when lang <> 'es' then array(lang) else array() end as languages",
        "case when lang <> 'fr' then concat(n_chars, '.7') else 'many' end as downloads",
    )
    cards = documents.filter("lang <> 'de'").select(
        F.concat(F.lit("org__doc-"), "doc_id").alias("card_key"), X.strip("text").alias("card_text")
    )
    return rows, cards


_CARD = "CASE WHEN lang <> 'de' THEN regexp_replace(regexp_replace(text, '^[ \\n]+', ''), '[ \\n]+$', '') END"


@query(
    "parquet_records",
    f"""SELECT 'org/doc-' || doc_id AS id, 'hf' AS source,
       CASE WHEN lang <> 'fr' THEN 'my_' || source || '-set' ELSE 'doc-' || doc_id END AS ns_local_id,
       CASE WHEN lang <> 'fr' THEN 'My S' || substr(source, 2) || ' Set' ELSE 'Doc ' || doc_id END AS title,
       CAST(NULL AS VARCHAR) AS description, {_CARD} AS readme_text,
       CASE WHEN lang <> 'es' THEN lang || '-1.0' END AS license_class,
       CASE WHEN source = 'src0' THEN 'private' ELSE 'public' END AS access_class,
       CASE WHEN lang <> 'de' THEN source || ':x' END AS size_class, md5(text) AS readme_sha256,
       'pipeline:org/doc-' || doc_id AS fingerprint,
       CAST(CASE WHEN lang = 'de' THEN 0 ELSE {_TOKENS} END AS INTEGER) AS readme_tokens,
       CASE WHEN lang = 'de' THEN 0 ELSE least({_TOKENS} / 50.0, 1.0) END::DOUBLE AS readme_score,
       CAST(NULL AS VARCHAR) AS schema_hint,
       CASE WHEN lang = 'de' THEN '["lang:de"]' ELSE '["lang:' || lang || '", "size_categories:' || source || ':x"]' END AS tags,
       CASE lang WHEN 'en' THEN '["image", "text"]' END AS modalities,
       CASE WHEN lang <> 'es' THEN '["' || lang || '"]' END AS languages,
       CASE WHEN source = 'src7' THEN '["gated"]' END AS eligibility_flags,
       CAST(NULL AS BIGINT) AS last_seen_lm, epoch_us({AS_OF}) AS indexed_at,
       CASE WHEN lang <> 'fr' THEN CAST(n_chars AS VARCHAR) END AS downloads, CAST(NULL AS VARCHAR) AS likes
FROM documents WHERE source <> 'src2'""",
)
def parquet_records(spark, folder):
    """Catalog records of enriched rows and their README cards."""
    return _flat_records(I.ingest_parquet(*parquet_rows(spark, folder), as_of=V.CATALOG_AS_OF).records)


def entries(spark, folder):
    """Documents as entries of a catalog document, with missing fields, bad ids and repeated ids."""
    documents = V.table(spark, folder, "documents")
    identifier = "case when source = 'src3' then '  ' when lang = 'fr' then concat('dup-', source) else concat('doc-', doc_id) end"
    text = f"""case when lang = 'es' then to_json(named_struct('id', concat('doc-', doc_id), 'title', source))
      when source = 'src4' then to_json(named_struct('id', doc_id, 'source', 'hf', 'ns_local_id', source))
      else to_json(named_struct('id', {identifier}, 'source', 'hf', 'ns_local_id', source, 'title', lang,
        'readme_text', text, 'access_class', case when lang = 'de' then 'gated' end,
        'quality_signals', map('downloads', n_chars))) end"""
    return documents.select(
        F.struct("doc_id").alias("seq"), F.col("doc_id").alias("position"), J.parse(F.expr(text)).alias("entry")
    )


_ENTRIES = """
entries AS (
  SELECT *, CASE WHEN lang = 'es' THEN 'doc-' || doc_id WHEN source = 'src4' THEN CAST(doc_id AS VARCHAR)
                 WHEN source = 'src3' THEN '  ' WHEN lang = 'fr' THEN 'dup-' || source ELSE 'doc-' || doc_id END AS id
  FROM documents),
checked AS (
  SELECT *, CASE WHEN lang = 'es' THEN 'missing_fields' WHEN source IN ('src3', 'src4') THEN 'blank_id' END AS reason
  FROM entries),
marked AS (
  SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY doc_id) > 1
                 THEN 'duplicate_id' ELSE reason END AS reject_reason FROM checked)"""


@query(
    "validate_entries",
    f"""WITH {_ENTRIES}
    SELECT doc_id, CASE WHEN source = 'src4' AND lang <> 'es' AND doc_id = 0 THEN 'entry[0]' ELSE id END AS label, reject_reason,
           CASE reject_reason WHEN 'missing_fields' THEN 'missing required fields: [''ns_local_id'', ''source'']'
             WHEN 'blank_id' THEN '''id'' must be a non-empty string' ELSE 'duplicate id — skipped' END AS message
    FROM marked WHERE reject_reason IS NOT NULL""",
)
def validate_entries(spark, folder):
    errors = I.validate_entries(entries(spark, folder))[1]
    return errors.select("seq.doc_id", "label", "reject_reason", "message")


@query(
    "catalog_records",
    f"""WITH {_ENTRIES}
    SELECT id, source AS ns_local_id, lang AS title, text AS readme_text,
           CASE WHEN lang = 'de' THEN 'gated' ELSE 'public' END AS access_class, 'catalog:' || id AS fingerprint,
           CAST({_TOKENS} AS INTEGER) AS readme_tokens, CAST(n_chars AS VARCHAR) AS downloads
    FROM marked WHERE reject_reason IS NULL""",
)
def catalog_records(spark, folder):
    records = _flat_records(I.ingest_catalog(entries(spark, folder), V.CATALOG_AS_OF).records)
    return records.select(
        "id", "ns_local_id", "title", "readme_text", "access_class", "fingerprint", "readme_tokens", "downloads"
    )


_LISTING = """
listing AS (
  SELECT 'cust' || o_custkey || '/order-' || o_orderkey AS id, 'order-' || o_orderkey AS ns_local_id,
         o_orderdate AS lm, CASE WHEN o_orderstatus <> 'O' THEN 'mit' END AS license_class,
         CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END AS access_class,
         sha256('hf|order-' || o_orderkey || '||' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00||'
                || CASE WHEN o_orderstatus <> 'O' THEN 'mit' ELSE '' END) AS fingerprint,
         CAST(o_custkey AS VARCHAR) AS likes
  FROM orders)"""
_LISTED = "SELECT id, ns_local_id, license_class, access_class, fingerprint, likes, epoch_us(lm) AS last_seen_lm FROM listing"
CURSOR = ("1998-06-01T00:00:00+00:00", "cust5")
_BEYOND = "WHERE lm > TIMESTAMP '1998-06-01' OR (lm = TIMESTAMP '1998-06-01' AND id > 'cust5')"


def _listed(records):
    flat = _flat_records(records)
    return flat.select("id", "ns_local_id", "license_class", "access_class", "fingerprint", "likes", "last_seen_lm")


@query("listing_increment", f"WITH {_LISTING} {_LISTED} {_BEYOND}")
def listing_increment(spark, folder):
    return _listed(I.ingest_listing(V.listing(spark, folder), CURSOR, as_of=V.CATALOG_AS_OF)[0])


@query("listing_oldest_first", f"WITH {_LISTING} {_LISTED} {_BEYOND} ORDER BY lm, id LIMIT 500")
def listing_oldest_first(spark, folder):
    return _listed(I.ingest_listing(V.listing(spark, folder), CURSOR, limit=500, as_of=V.CATALOG_AS_OF)[0])


@query("listing_backfill", f"WITH {_LISTING} {_LISTED} WHERE lm >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY")
def listing_backfill(spark, folder):
    floor = I.backfill_floor(7, "2001-08-01 00:00:00")
    return _listed(I.ingest_listing(V.listing(spark, folder), floor=floor, as_of=V.CATALOG_AS_OF)[0])


@query("new_cursor", f"""WITH {_LISTING} SELECT epoch_us(lm) AS last_seen_lm, id FROM listing {_BEYOND}
ORDER BY lm DESC, id DESC LIMIT 1""")
def new_cursor(spark, folder):
    cursor = I.ingest_listing(V.listing(spark, folder), CURSOR, as_of=V.CATALOG_AS_OF)[1]
    return cursor.select(F.unix_micros("last_seen_lm").alias("last_seen_lm"), "id")


def updates(spark, folder):
    """Records to put in: changed and unchanged documents, and benchmark items as new datasets, each twice."""
    documents = V.table(spark, folder, "documents").join(V.table(spark, folder, "labels"), "doc_id").selectExpr(
        "cast(doc_id as string) as id", "case when toxic = 1 then 'changed' else 'same' end as title",
        "case when toxic = 1 then concat('v2:', doc_id) else concat('doc:', doc_id, ':', n_chars) end as fingerprint",
        "1 as seq",
    )
    items = V.table(spark, folder, "benchmark").select(
        F.concat(F.lit("bench-"), "item_id").alias("id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"),
    ).selectExpr("id", "concat('take ', seq) as title", "concat('fp', seq) as fingerprint", "seq")
    records = documents.unionByName(items)
    return conform(records, "datasets", keep=["seq"])


_UPDATES = """
updates AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'changed' ELSE 'same' END AS title,
         CASE WHEN toxic = 1 THEN 'v2:' || doc_id ELSE 'doc:' || doc_id || ':' || n_chars END AS fingerprint
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'bench-' || item_id, 'take 2', 'fp2' FROM benchmark)"""


def _applied(spark, folder):
    return I.apply_records(
        V.datasets(spark, folder), V.artifacts(spark, folder), updates(spark, folder), V.CATALOG_AS_OF
    )


@query("upsert_datasets", f"""WITH {DATASETS}, {_UPDATES}
SELECT id, title, fingerprint FROM updates UNION ALL
SELECT id, title, fingerprint FROM datasets WHERE id NOT IN (SELECT id FROM updates)""")
def upsert_datasets(spark, folder):
    return _applied(spark, folder).datasets.select("id", "title", "fingerprint")


@query("change_events", f"""WITH {DATASETS}, {_UPDATES}
SELECT CASE WHEN d.id IS NULL THEN 'dataset.discovered' ELSE 'dataset.changed' END AS type, u.id AS dataset_id,
       CASE WHEN d.id IS NULL THEN '{{"fingerprint_new":"' || u.fingerprint || '"}}'
            ELSE '{{"fingerprint_old":"' || d.fingerprint || '","fingerprint_new":"' || u.fingerprint || '"}}' END AS payload
FROM updates u LEFT JOIN datasets d ON d.id = u.id WHERE d.id IS NULL OR d.fingerprint <> u.fingerprint""")
def change_events(spark, folder):
    return _applied(spark, folder).events.select("type", "dataset_id", "payload")


@query("stale_artifacts", f"""WITH {DATASETS}, {ARTIFACTS}, {_UPDATES}
SELECT a.dataset_id, kind, stale OR (d.fingerprint <> u.fingerprint) AS stale FROM artifacts a
JOIN datasets d ON d.id = a.dataset_id JOIN updates u ON u.id = d.id""")
def stale_artifacts(spark, folder):
    return _applied(spark, folder).artifacts.select("dataset_id", "kind", "stale")


@query("artifacts_put", f"""WITH {ARTIFACTS}, new AS (SELECT CAST(doc_id AS VARCHAR) AS dataset_id FROM documents WHERE lang = 'en')
SELECT dataset_id, 'schema' AS kind, false AS stale, '[]' AS payload FROM new UNION ALL
SELECT dataset_id, kind, stale, '{{}}' FROM artifacts WHERE kind <> 'schema' OR dataset_id NOT IN (SELECT dataset_id FROM new)""")
def artifacts_put(spark, folder):
    new = V.table(spark, folder, "documents").filter("lang = 'en'").selectExpr(
        "cast(doc_id as string) as dataset_id", "'schema' as kind", "'[]' as payload", "false as stale"
    )
    return K.put_artifacts(V.artifacts(spark, folder), new).select("dataset_id", "kind", "stale", "payload")


@query("jobs_enqueued", f"""WITH {JOBS}
SELECT id, CASE WHEN state = 'error' THEN 'queued' ELSE state END AS state,
       CAST(CASE WHEN state = 'error' THEN 0 ELSE attempts END AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error_class
FROM jobs""")
def jobs_enqueued(spark, folder):
    """Failed jobs enqueued again."""
    jobs = V.jobs(spark, folder)
    again = jobs.filter("state = 'error'").selectExpr(
        "id", "dataset_id", "kind", "'queued' as state", "0 as attempts", "enqueued_at"
    )
    return K.enqueue_jobs(jobs, again).select("id", "state", "attempts", "error_class")


@query(
    "cursor_merge",
    """WITH base AS (SELECT c_name AS source, 'c' || c_custkey AS cursor, c_nationkey AS qps_limit, c_mktsegment AS backoff_state FROM customer),
    new AS (SELECT c_name AS source, 'o' || max(o_orderkey) AS cursor, CAST(NULL AS INTEGER) AS qps_limit
            FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
            UNION ALL SELECT s_name, 's', s_nationkey FROM supplier)
    SELECT coalesce(n.source, b.source) AS source, CASE WHEN n.source IS NULL THEN b.cursor ELSE n.cursor END AS cursor,
           coalesce(n.qps_limit, b.qps_limit) AS qps_limit, b.backoff_state
    FROM base b FULL JOIN new n ON n.source = b.source""",
)
def cursor_merge(spark, folder):
    customers = V.table(spark, folder, "customer")
    base = conform(customers.selectExpr(
        "c_name as source", "concat('c', c_custkey) as cursor", "c_nationkey as qps_limit",
        "c_mktsegment as backoff_state"), "connectors")
    orders = V.table(spark, folder, "orders")
    seen = customers.join(orders, customers["c_custkey"] == orders["o_custkey"]).groupBy(
        F.col("c_name").alias("source")).agg(F.concat(F.lit("o"), F.max("o_orderkey")).alias("cursor"))
    added = V.table(spark, folder, "supplier").selectExpr("s_name as source", "'s' as cursor", "s_nationkey as qps_limit")
    new = conform(seen, "connectors").unionByName(conform(added, "connectors"))
    return K.merge_connectors(base, new)


def readmes(spark, folder):
    """Documents with headings put before, after or between."""
    documents = V.table(spark, folder, "documents")
    return documents.selectExpr(
        "doc_id",
        """case lang when 'en' then concat('# ', source, ' #\\n\\n', text, '\\n## late')
           when 'fr' then concat(text, '\\n#tail\\nrest\\n# never') when 'de' then concat('#\\n', text, '\\n###') else text end as readme""",
    )


_STRIP = "regexp_replace(regexp_replace({}, '^[ \\n]+', ''), '[ \\n]+$', '')"


@query(
    "readme_stats",
    f"""WITH readmes AS (
      SELECT doc_id, CASE lang WHEN 'en' THEN '# ' || source || ' #\n\n' || text || '\n## late'
             WHEN 'fr' THEN text || '\n#tail\nrest\n# never' WHEN 'de' THEN '#\n' || text || '\n###' ELSE text END AS readme
      FROM documents),
    split AS (SELECT doc_id, unnest(string_split_regex(readme, '{LINE_END}')) AS raw,
                     generate_subscripts(string_split_regex(readme, '{LINE_END}'), 1) AS pos FROM readmes),
    lines AS (SELECT doc_id, pos, {_STRIP.format('raw')} AS line FROM split),
    kinds AS (SELECT doc_id, pos, line, line LIKE '#%' AS heading,
                     nullif({_STRIP.format("regexp_replace(line, '^#+', '')")}, '') AS title FROM lines WHERE line <> ''),
    last AS (SELECT *, max(CASE WHEN heading THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS above FROM kinds),
    stops AS (SELECT l.doc_id, min(l.pos) AS stop FROM last l JOIN kinds h ON h.doc_id = l.doc_id AND h.pos = l.above
              WHERE NOT l.heading AND h.title IS NOT NULL GROUP BY 1),
    titles AS (SELECT k.doc_id, arg_max(coalesce(k.title, ''), k.pos) AS title FROM kinds k LEFT JOIN stops s USING (doc_id)
               WHERE k.heading AND k.pos < coalesce(s.stop, 1000000000) GROUP BY 1),
    described AS (SELECT doc_id, arg_min(line, pos) AS description FROM kinds WHERE NOT heading GROUP BY 1),
    counted AS (SELECT doc_id, len(regexp_extract_all(readme, '{NOT_SPACE}')) AS n FROM readmes)
    SELECT doc_id, CAST(n AS INTEGER) AS tokens, round(least(ln(1 + n) / ln(401), 1.0), 9) AS score,
           nullif(title, '') AS title, description
    FROM counted LEFT JOIN titles USING (doc_id) LEFT JOIN described USING (doc_id)""",
)
def readme_stats(spark, folder):
    stats = readmes(spark, folder).select("doc_id", X.readme_stats("readme").alias("stats")).select("doc_id", "stats.*")
    return stats.withColumn("score", F.round("score", 9))


@query("fingerprints", f"""WITH {DATASETS}
SELECT id, sha256('hf|' || ns_local_id || '|' || sha256(readme_text) || '|' || strftime(last_seen_lm, '%Y-%m-%dT%H:%M:%S')
                  || '+00:00|' || size_class || '|' || coalesce(license_class, '')) AS fingerprint FROM datasets""")
def fingerprints(spark, folder):
    parts = [F.lit("hf"), "ns_local_id", "readme_sha256", iso_format("last_seen_lm"), "size_class", "license_class"]
    return V.datasets(spark, folder).select("id", X.fingerprint(*parts).alias("fingerprint"))


@query(
    "modalities_from_tasks",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'text image' WHEN 'de' THEN 'tabular text' WHEN 'es' THEN 'audio text' END AS modalities
       FROM documents""",
)
def modalities_from_tasks(spark, folder):
    tasks = F.expr("""case lang when 'en' then array('text-classification', source, 'image-to-text') when 'fr' then array(source)
      when 'de' then array('tabular-to-text', null, 'translation') else array('text-to-speech', 'audio-classification') end""")
    documents = V.table(spark, folder, "documents")
    return documents.select("doc_id", F.array_join(X.modalities_of(tasks), " ").alias("modalities"))
