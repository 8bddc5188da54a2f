"""Sample-row and schema-resolution queries."""

from pyspark.sql import functions as F

from shelfmark import views as V
from shelfmark.functions import json as J
from shelfmark.operators.policy import PolicySettings
from shelfmark.plans import resolve as R
from shelfmark.plans import samples as S
from shelfmark.schemas import conform
from shelfmark.workload.registry import TERM, query

_ASKED = "CASE WHEN role = 'user' THEN 'True' ELSE 'False' END"
_ROW_TEXT = f"role || ' ' || text || ' ' || turn || ' ' || {_ASKED}"


@query(
    "flatten_samples",
    f"""SELECT 'conv-' || conv_id || '::' || role || '::train::' || place AS row_id, 'conv-' || conv_id AS dataset_id,
               role AS config, 'train' AS split, '2024-01-31' AS sampled_at, CAST(place AS INTEGER) AS row_index, row_text
        FROM (SELECT *, {_ROW_TEXT} AS row_text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place
              FROM conversations)""",
)
def flatten_samples(spark, folder):
    return S.flatten_samples(V.sample_lines(spark, folder)).drop("row")


@query("sample_row_text", f"SELECT conv_id, turn, {_ROW_TEXT} AS row_text FROM conversations")
def sample_row_text(spark, folder):
    row = F.to_json(F.struct("role", "text", "turn", (F.col("role") == "user").alias("asked")))
    rows = V.table(spark, folder, "conversations").select("conv_id", "turn", row.alias("row"))
    return rows.select("conv_id", "turn", J.row_text("row").alias("row_text"))


@query("sample_datasets", """SELECT 'conv-' || conv_id AS dataset_id, count(*) AS row_count FROM conversations GROUP BY 1
ORDER BY 1 LIMIT 50 OFFSET 50""")
def sample_datasets(spark, folder):
    return S.list_sample_datasets(V.sample_rows(spark, folder), limit=50, offset=50)


_MATCH = f"list_has_any(regexp_extract_all(lower(text), '{TERM}'), ['the', 'que'])"


@query("sample_datasets_query", f"""SELECT 'conv-' || conv_id AS dataset_id, count(*) AS row_count FROM conversations
WHERE {_MATCH} GROUP BY 1 ORDER BY 1 LIMIT 50""")
def sample_datasets_query(spark, folder):
    return S.list_sample_datasets(V.sample_rows(spark, folder), "The, que!")


@query("sample_dataset_total", f"SELECT count(DISTINCT conv_id) AS total FROM conversations WHERE {_MATCH}")
def sample_dataset_total(spark, folder):
    return S.sample_dataset_total(V.sample_rows(spark, folder), "The, que!")


@query(
    "sample_rows_topn",
    """SELECT * FROM (
         SELECT 'conv-' || conv_id AS dataset_id, role AS config, 'train' AS split, CAST(turn AS INTEGER) AS row_index,
                CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS INTEGER) AS rank
         FROM conversations) WHERE rank <= 3""",
)
def sample_rows_topn(spark, folder):
    return S.sample_rows_batch(V.sample_rows(spark, folder), limit=3).drop("row")


@query("sample_rows", """SELECT role AS config, 'train' AS split, CAST(turn AS INTEGER) AS row_index FROM conversations
WHERE conv_id = 1 ORDER BY role, turn LIMIT 100""")
def sample_rows(spark, folder):
    return S.sample_rows(V.sample_rows(spark, folder), "conv-1").drop("row")


@query("has_sample_rows", """SELECT 'conv-' || doc_id AS dataset_id,
doc_id IN (SELECT conv_id FROM conversations) AS has_sample_rows FROM documents""")
def has_sample_rows(spark, folder):
    hits = V.table(spark, folder, "documents").select(F.concat(F.lit("conv-"), "doc_id").alias("dataset_id"))
    return S.has_sample_rows(hits, V.sample_rows(spark, folder))


def mixed_rows(spark, folder):
    """Conversation turns as rows of changing shape: 'mixed' holds a number or a text, 'gap' is NULL or absent."""
    asked = F.to_json(F.struct("role", F.col("turn").alias("mixed")))
    other = F.to_json(
        F.struct(F.lit(None).cast("string").alias("gap"), "role", F.col("text").alias("mixed")),
        {"ignoreNullFields": "false"},
    )
    return V.table(spark, folder, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("dataset_id"),
        F.col("role").alias("config"),
        F.lit("train").alias("split"),
        F.col("turn").cast("int").alias("row_index"),
        F.when(F.col("role") == "user", asked).otherwise(other).alias("row"),
    )


@query(
    "infer_schema",
    """WITH cells AS (
         SELECT conv_id, CAST(turn AS INTEGER) AS turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS pos, 'role' AS name, 'string' AS dtype, '"' || role || '"' AS example FROM conversations
         UNION ALL SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END, 'mixed', CASE WHEN role = 'user' THEN 'int64' ELSE 'string' END, 'x' FROM conversations
         UNION ALL SELECT conv_id, turn, 0, 'gap', 'null', 'null' FROM conversations WHERE role <> 'user'),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn) AS n FROM cells)
       SELECT 'conv-' || conv_id AS dataset_id, name, arg_min(dtype, turn) AS dtype, bool_or(dtype = 'null') AS nullable,
              CAST(min(turn) AS INTEGER) AS row_index, CAST(arg_min(pos, turn) AS INTEGER) AS pos,
              string_agg(example, ' ' ORDER BY turn) FILTER (n <= 3) AS examples
       FROM ranked GROUP BY conv_id, name""",
)
def infer_schema(spark, folder):
    fields = R.infer_schema(mixed_rows(spark, folder))
    shown = F.when(F.col("name") == "mixed", F.transform("examples", lambda _: F.lit("x"))).otherwise(F.col("examples"))
    return fields.select(
        "dataset_id", "name", "dtype", "nullable", "position.row_index", F.col("position.at").alias("pos"),
        F.array_join(shown, " ").alias("examples"),
    )


@query(
    "features_choice",
    """SELECT 'd' || doc_id AS dataset_id,
         CASE lang WHEN 'en' THEN '[{"dtype":"string","name":"' || source || '"}]' WHEN 'fr' THEN '{"a":"int"}' END AS features,
         CASE lang WHEN 'en' THEN source WHEN 'fr' THEN 'given' WHEN 'de' THEN 'first' END AS config,
         CASE lang WHEN 'en' THEN 'test' WHEN 'fr' THEN 'train' WHEN 'de' THEN 'train' END AS split
       FROM documents""",
)
def features_choice(spark, folder):
    info = V.table(spark, folder, "documents").selectExpr(
        "concat('d', doc_id) as dataset_id",
        """case lang
             when 'en' then concat('{"splits":[{"config":"first","split":"train"},{"config":"', source,
               '","split":"test","features":[{"name":"', source, '","dtype":"string"}]}]}')
             when 'fr' then '{"default_config":"given","splits":[{"config":"c","split":"train","features":[]}],"features":{"a":"int"}}'
             when 'de' then '{"splits":[{"config":"first","split":"train"}]}'
             else '{}' end as payload""",
    )
    return R.declared_features(info)


@query(
    "card_features",
    """SELECT 'd' || doc_id AS dataset_id,
         CASE lang WHEN 'en' THEN '[{"name":"z","dtype":"' || source || '"},{"name":"a","dtype":"int8"}]'
                   ELSE '[{"name":"x"}]' END AS features
       FROM documents WHERE lang IN ('en', 'fr')""",
)
def card_features(spark, folder):
    cards = V.table(spark, folder, "documents").selectExpr(
        "concat('d', doc_id) as dataset_id",
        """case lang
             when 'en' then concat('{"dataset_info":{"features":{"z":{"dtype":"', source, '"},"a":"int8"}}}')
             when 'fr' then '{"dataset_info":{"features":[{"name":"x"}]}}'
             when 'de' then '{"dataset_info":{}}' else '{"other":1}' end as payload""",
    )
    return R.card_features(cards)


def _resolved(spark, folder):
    talks = V.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max(F.col("role") == "system").alias("failed")
    ).withColumn("dataset_id", F.concat(F.lit("conv-"), "conv_id"))
    jobs = conform(talks.selectExpr(
        "concat('job-', conv_id) as id", "dataset_id", "'schema' as kind", "'queued' as state", "0 as attempts",
        "case when turns > 6 then 0 else 150 end as row_cap", "1500 as budget_ms",
        f"timestamp'{V.CATALOG_AS_OF}' as enqueued_at"), "jobs")
    info = talks.selectExpr(
        "dataset_id",
        """case when turns > 4 then '{"default_config":"user","default_split":"train"}'
           when turns > 3 then '{"default_config":"nobody","default_split":"train"}'
           else '{"features":[{"name":"declared"}]}' end as payload""")
    cards = talks.filter("turns = 4").selectExpr(
        "dataset_id", """'{"dataset_info":{"features":{"b":"int8","a":{"dtype":"string"}}}}' as payload""")
    failures = talks.filter("failed").selectExpr(
        "dataset_id", "'http' as error_kind", "503 as http_status", "repeat('x', 600) as error_detail")
    return R.resolve_schemas(
        jobs, info, mixed_rows(spark, folder), cards, failures, as_of=V.CATALOG_AS_OF
    )


_TALKS = """talks AS (
  SELECT conv_id, 'conv-' || conv_id AS dataset_id, count(*) AS turns, bool_or(role = 'system') AS failed,
         bool_or(role = 'user') AS asked FROM conversations GROUP BY ALL)"""


@query(
    "resolve_artifacts",
    f"""WITH {_TALKS}
    SELECT dataset_id, 'schema' AS kind, false AS stale,
           CASE WHEN turns > 4 AND asked THEN 'role,mixed' WHEN turns > 4 THEN '' WHEN turns > 3 THEN 'b,a' ELSE 'declared' END AS names,
           CASE WHEN turns > 4 AND asked THEN 'user' WHEN turns = 4 THEN 'nobody' END AS config,
           CASE WHEN turns > 6 THEN 200 ELSE 150 END AS row_cap_applied,
           CASE WHEN turns > 4 AND NOT asked THEN 'schema_not_available' END AS note
    FROM talks WHERE NOT failed""",
)
def resolve_artifacts(spark, folder):
    """Schemas of all conversations: declared, inferred from rows, or out of the card."""
    artifacts = _resolved(spark, folder).artifacts
    payload = J.parse("payload")
    names = F.transform(
        F.try_variant_get(payload, "$.schema", "array<variant>"), lambda item: J.text_of(item, "name")
    )
    return artifacts.select(
        "dataset_id", "kind", "stale", F.array_join(names, ",").alias("names"),
        J.text_of(payload, "config").alias("config"),
        F.try_variant_get(payload, "$.row_cap_applied", "int").alias("row_cap_applied"),
        J.text_of(payload, "note").alias("note"),
    )


_CAPS = "(1), (150), (500), (0)"


@query(
    "resolve_row_caps",
    f"""WITH ranked AS (
      SELECT role, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS place FROM conversations),
    jobs AS (SELECT role, cap, CASE WHEN cap = 0 THEN 300 ELSE cap END AS applied
             FROM (SELECT DISTINCT role FROM conversations), (VALUES {_CAPS}) AS caps(cap)),
    fields AS (
      SELECT j.role, j.cap, applied, turn, min(place) AS first, count(*) AS held
      FROM jobs j JOIN ranked r ON r.role = j.role AND place <= applied GROUP BY ALL)
    SELECT 'job-' || role || '-' || cap AS id, applied AS row_cap_applied,
           string_agg('t' || turn, ',' ORDER BY first) AS names
    FROM fields GROUP BY role, cap, applied""",
)
def resolve_row_caps(spark, folder):
    """Four jobs per role over the rows of all its turns: each sees its own first rows; 0 asks for the settings' number."""
    turns = V.table(spark, folder, "conversations")
    rows = turns.select(
        F.col("role").alias("dataset_id"), F.lit("c").alias("config"), F.lit("train").alias("split"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"),
        F.format_string('{"t%d":%d}', F.col("turn").cast("long"), F.col("turn").cast("long")).alias("row"),
    )
    roles = turns.select(F.col("role").alias("dataset_id")).distinct()
    jobs = conform(roles.selectExpr(
        "dataset_id", "explode(array(1, 150, 500, 0)) as row_cap").selectExpr(
        "concat('job-', dataset_id, '-', row_cap) as id", "dataset_id", "'schema' as kind", "'queued' as state",
        "0 as attempts", "row_cap", f"timestamp'{V.CATALOG_AS_OF}' as enqueued_at"), "jobs")
    info = roles.selectExpr("dataset_id", """'{"splits":[{"config":"c","split":"train"}]}' as payload""")
    cards = roles.filter("false").selectExpr("dataset_id", "'{}' as payload")
    done = R.resolve_payloads(jobs, info, rows, cards, settings=PolicySettings(row_cap=300))
    payload = J.parse("payload")
    names = F.transform(F.try_variant_get(payload, "$.schema", "array<variant>"), lambda item: J.text_of(item, "name"))
    return done.select(
        "id", F.try_variant_get(payload, "$.row_cap_applied", "int").alias("row_cap_applied"), F.array_join(names, ",").alias("names")
    )


@query(
    "resolve_jobs",
    f"""WITH {_TALKS}
    SELECT 'job-' || conv_id AS id, CASE WHEN failed THEN 'error' ELSE 'done' END AS state,
           CASE WHEN failed THEN 'network' END AS error_class, CASE WHEN failed THEN 600 END AS detail
    FROM talks""",
)
def resolve_jobs(spark, folder):
    return _resolved(spark, folder).jobs.select("id", "state", "error_class", F.length("error_detail").alias("detail"))


@query(
    "resolve_events",
    f"""WITH {_TALKS}
    SELECT dataset_id, CASE WHEN failed THEN 'dataset.resolved_err' ELSE 'dataset.resolved_ok' END AS type,
           'job-' || conv_id AS job_id, CASE WHEN failed THEN 500 END AS detail
    FROM talks""",
)
def resolve_events(spark, folder):
    events = _resolved(spark, folder).events
    return events.select(
        "dataset_id", "type", F.get_json_object("payload", "$.job_id").alias("job_id"),
        F.length(F.get_json_object("payload", "$.error_detail")).alias("detail"),
    )
