"""URL filters against brute force over all rules."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import url_filter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end].translate(LOWER), rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fitting = []
    for r_host, r_path, verdict in rules:
        r_host, r_path = (r_host or "").translate(LOWER), r_path or ""
        if (not r_host or host == r_host or host.endswith("." + r_host)) and path.startswith(r_path):
            fitting.append((len(r_host + r_path), len(r_host), r_host + r_path, verdict))
    best = max(fitting, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def compare(spark, urls, rules, slices="4"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, key string, opened string")
        rows = U.judge_urls(pages, spark.createDataFrame(rules, U.RULES_SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, rows)) == [(i, *judged(u, rules)) for i, u in enumerate(urls)]


def test_odd_urls(spark):
    urls = [None, "", "example.org/es/", "://", "http://", "HTTP://EXAMPLE.ORG/es/1", "http://example.org", "http://example.org?x=/es/",
            "http://org/", "http://a.example.org/en/12#top", "http://xorg/", "http://notexample.org/es/", "http://a..org/en", "http://.org/",
            "x://com/fr/://", "http://user@b.com:80/de/", "http://b.com/de/é\n/x?y", "http://b.com/DE/", "http://" + "a." * 3000 + "com/fr/" + "z" * 90_000,
            "http://example.org/es/\u0000", "http://b.com/fr/", "http://b.com/fr/"]
    compare(spark, urls, U.RULES)


def test_no_rules_and_no_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], U.RULES_SCHEMA)
    assert [tuple(r) for r in U.judge_urls(pages, none, default="block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert U.judge_urls(pages.limit(0), spark.createDataFrame(U.RULES, U.RULES_SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_nested_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    domain = lambda: ".".join(rng.choice(("a", "b", "B", "com")) for _ in range(rng.randint(1, 4)))
    path = lambda most: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, most)))
    rules = [(rng.choice((domain(), domain(), None, "")), rng.choice((path(4), path(2), "", None)), rng.choice(("allow", "block"))) for _ in range(60)]
    urls = [f"http://{domain()}{path(7)}" for _ in range(400)] * 2
    compare(spark, urls, rules, slices=str(rng.choice((1, 7, 31))))


def test_one_slice_per_key_hands_on_open_rules(spark):
    """Rules opened at the very first keys hold in all later slices."""
    rules = [("com", "/", "block"), ("com", "/m", "allow"), ("com", "/mm", "block")]
    compare(spark, [f"http://com/{a}{b}" for a in "amz" for b in ("", "m", "ma", "mz", "z")], rules, slices="40")


def test_no_python_in_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = U.judge_urls(pages, spark.createDataFrame(U.RULES, U.RULES_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_of_one_text(spark):
    rules = spark.createDataFrame([("A.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "maybe"), ("a.com", "/y", None)], U.RULES_SCHEMA)
    assert [r["verdict"] for r in U.prepare_rules(rules).orderBy(F.col("rule")).collect()] == ["block"]
