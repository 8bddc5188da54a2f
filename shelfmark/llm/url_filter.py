"""URL filters: a sort-merge range join of urls with host and path rules, by built-in functions alone.

The canonical key of a rule is its host with the labels reversed, a mark that sorts before all
characters of hosts, and its path: ``org.example|/es/``. All urls that the rule fits at that host
have keys with this prefix, so a rule is an interval of keys, and two rules nest or are apart. A
url is looked for under each host that a rule may have: its own and the domains above it.

Starts and ends of rules and the keys of urls are sorted together over many slices. In this order
a running sum of starts less ends is the depth of the stack of open rules, and the top of the stack
at depth ``d`` is the last rule opened at depth ``d``. Each slice begins with the depth and the
tops that the slices before it leave; of those only one row per slice and depth moves.

Rows of the result, one per row of urls:

- a null url, or one without ``://``, has an empty host and path;
- the host is what follows the first ``://`` (with user and port), A-Z lower-cased;
- no rule: ``rule`` is null and the verdict is ``default``, here ``allow``: a filter names what it blocks;
- of several rules that fit, the one with the most characters in host and path wins, of equally
  long ones the one with the longer host, and of rules of the same text ``block``;
- equal urls are judged once and repeated rows stay; further columns of the urls are not looked at;
- an empty table of urls gives no row; without rules all get the default.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.texts import written

RULES_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Sorts before every character of a host; and after every string of UTF-8.
_MARK, _LAST = "\x00", "X'FF'"
# Order of events with equal keys: a rule is open for the url that is its very text.
_START, _URL, _END = 0, 1, 2


def host_and_path(url):
    """Columns (host, path) of a url."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _labels(host):
    """The labels of a host from the last to the first; none of an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(key, domain, labels, rule, size, host_size, verdict): one row for each text of a rule.

    A rule without a host (null or empty) fits all hosts, one without a path fits all paths.
    """
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    path = F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), F.lower("verdict").alias("verdict"))
    named = named.filter(F.col("verdict").isin("allow", "block"))
    single = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    return single.select(
        F.concat(F.array_join(_labels(F.col("host")), "."), F.lit(_MARK), "path").alias("key"),
        F.array_join(_labels(F.col("host")), ".").alias("domain"),
        F.size(_labels(F.col("host"))).alias("labels"),
        F.concat("host", "path").alias("rule"),
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        "verdict",
    )


def _events(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Starts and ends of rules, and the keys of urls below domains that have a rule."""
    # Bounded: one row of two numbers, the deepest host of a rule.
    deepest = rules.agg(F.max("labels")).first()[0]
    labels = _labels(F.col("host"))
    depth = F.explode(F.sequence(F.lit(0), F.least(F.size(labels), F.lit(deepest))))
    under = urls.select("host", "path", labels.alias("labels"), depth.alias("depth"))
    under = under.select("host", "path", F.array_join(F.slice("labels", 1, F.col("depth")), ".").alias("domain"))
    under = under.join(rules.select("domain").distinct(), "domain", "left_semi")
    key = F.concat("domain", F.lit(_MARK), "path").cast("binary")
    nothing = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    text = F.lit(None).cast("string")
    probes = under.select(key.alias("key"), F.lit(_URL).alias("kind"), F.lit(0).alias("step"), nothing.alias("opened"), "host", "path")
    opened = F.struct("size", "host_size", "rule", "verdict")
    start = rules.select(F.col("key").cast("binary").alias("key"), F.lit(_START).alias("kind"), F.lit(1).alias("step"), opened.alias("opened"), text.alias("host"), text.alias("path"))
    end = rules.select(F.expr(f"concat(cast(key as binary), {_LAST})").alias("key"), F.lit(_END).alias("kind"), F.lit(-1).alias("step"), nothing.alias("opened"), text.alias("host"), text.alias("path"))
    return probes.unionByName(start).unionByName(end)


def sweep(events: DataFrame) -> DataFrame:
    """(host, path, opened): for each url key below an open rule, the innermost one.

    Equal keys, of one path on many hosts below a domain, are dealt by their hosts; no row comes twice.
    """
    dealt = written(events.repartitionByRange("key", "kind", "host").withColumn("slice", F.spark_partition_id()), "url-events")
    # What is summed below has one row per slice, or per slice and depth.
    steps = dealt.groupBy("slice").agg(F.sum("step").alias("net"))
    before = steps.select("slice", (F.sum("net").over(Window.orderBy("slice")) - F.col("net")).alias("depth_before"))
    in_order = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("depth", F.sum("step").over(in_order)).join(before, "slice")
    # An end is of no use any more: what it closed is known from the depth of what follows.
    placed = local.filter(F.col("kind") != _END).withColumn("depth", F.col("depth") + F.col("depth_before"))
    at_depth = Window.partitionBy("slice", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = placed.filter("depth > 0").withColumn("top", F.last("opened", ignorenulls=True).over(at_depth))
    here = written(here.select("slice", "depth", "key", "kind", "host", "path", "opened", "top"), "url-tops")
    found = here.filter((F.col("kind") == _URL) & F.col("top").isNotNull()).select("host", "path", F.col("top").alias("opened"))
    # Rules that were opened in an earlier slice: the last of each depth is handed on.
    waiting = here.filter((F.col("kind") == _URL) & F.col("top").isNull()).select("slice", "depth", "host", "path")
    left = here.filter(F.col("kind") == _START).groupBy("slice", "depth").agg(F.max_by("opened", "key").alias("opened"))
    asked = waiting.select("slice", "depth").distinct().withColumn("opened", F.lit(None).cast(left.schema["opened"].dataType))
    earlier = Window.partitionBy("depth").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    handed = left.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    handed = handed.withColumn("opened", F.last("opened", ignorenulls=True).over(earlier)).filter("asks").drop("asks")
    return found.unionByName(waiting.join(handed, ["slice", "depth"]).select("host", "path", "opened"))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``; see the module for what fits."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    named = written(prepare_rules(rules), "url-rules")
    if named.isEmpty():
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = split.select("host", "path").distinct()
    best = sweep(_events(distinct, named)).groupBy("host", "path").agg(F.max("opened").alias("opened"))
    judged = split.join(best, ["host", "path"], "left")
    verdict = F.coalesce(F.col("opened.verdict"), F.lit(default))
    return judged.select(key, "host", "path", F.col("opened.rule").alias("rule"), verdict.alias("verdict"))


# The rules of the query: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_VALUES = ", ".join(str(r) for r in RULES)


def query_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS rules(host, path, verdict)")


URL_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
),
urls AS (SELECT DISTINCT host, path FROM split),
fitting AS (
  SELECT host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS place
  FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (host, path)
"""
