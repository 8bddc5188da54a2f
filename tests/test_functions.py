import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import json as J
from shelfmark.functions import text as X
from shelfmark.functions import times as TM
from shelfmark.functions import vectors as V


def values(spark, texts, expression, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_tokens_split_like_python(spark):
    texts = ["a  b\tc", " x y z ", "", None, "one\x1ftwo\x85three　four", "\n\n"]
    got = values(spark, texts, X.whitespace_tokens("t"))
    assert got == [(t or "").split() for t in texts]


def test_tokens_of_random_text(spark):
    rng = random.Random(7)
    alphabet = "ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85        　​é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(300)]
    assert values(spark, texts, X.whitespace_tokens("t")) == [t.split() for t in texts]
    assert values(spark, texts, X.strip("t")) == [t.strip() for t in texts]


def test_title_case(spark):
    texts = ["3d it's", "élan vital", "my-set_2x", "ABC"]
    assert values(spark, texts, X.title_case("t")) == [t.title() for t in texts]


def test_json_text_matches_python_rendering(spark):
    import json

    lists = [["a", "b"], [], None, ['q"x', "back\\slash"], ["é", None]]
    got = values(spark, lists, X.json_text("t"), "array<string>")
    assert got == [None if x is None else json.dumps(x, ensure_ascii=False) for x in lists]


def stats_of(text):
    """The description of readme_stats, written out for one text."""
    title, description = None, None
    for line in (text or "").splitlines():
        line = line.strip()
        if not line:
            continue
        if line.startswith("#"):
            title = line.lstrip("#").strip() or None
        else:
            description = description or line
            if title:
                break
    return title, description


def test_readme_stats(spark):
    rng = random.Random(3)
    pool = ["# A", "## B", "#", "plain", "more text", "", "  ", "###  C  ", "x # y"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(200)] + [None, "pre\r\n# A\r\nz"]
    got = values(spark, texts, X.readme_stats("t"))
    for text, stats in zip(texts, got):
        assert (stats.title, stats.description) == stats_of(text), repr(text)
        n = len((text or "").split())
        assert stats.tokens == n
        assert stats.score == pytest.approx(min(1.0, math.log1p(n) / math.log1p(400)))


def test_modalities_and_sizes(spark):
    tasks = [["image-to-text", "summarization"], ["nonsense"], None, [], ["tabular-to-text", "image-to-text"]]
    got = values(spark, tasks, X.modalities_of("t"), "array<string>")
    assert got == [["image", "text"], None, None, None, ["tabular", "text", "image"]]
    assert values(spark, ["n<1K", "n>100M", "huge", None], X.size_rank("t")) == [0, 6, -1, -1]


def test_clean_string(spark):
    assert values(spark, [" a ", "nan", "", None, " nan "], X.clean_string("t")) == ["a", None, None, None, None]


def test_iso_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02", "soon", None]
    rendered = values(spark, texts, TM.iso_format(TM.parse_iso("t")))
    assert rendered == [
        datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).isoformat(),
        datetime(2024, 1, 2, 1, 4, 5, 500000, tzinfo=timezone.utc).isoformat(),
        datetime(2024, 1, 2, tzinfo=timezone.utc).isoformat(),
        None,
        None,
    ]


def test_iso_times_need_a_full_date(spark):
    texts = ["20240131", "20240131T0506Z", "20240131T050607.25+0100", "2024-01-31T05", "2024-01-31 05:06", "2024-01-31T05:06:07,5",
             "2024-01-31T05+02:00", "12:30:00", "T12:30", "2024", "2024-03", "2024-1-5", "2024-02-30", " 2024-01-31", "2024-01-31T25:00", ""]
    got = values(spark, texts, TM.iso_format(TM.parse_iso("t")))
    expected = []
    for text in texts:
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            expected.append(None)
            continue
        moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
        expected.append(moment.isoformat())
    assert got == expected


def test_truth_of_json_values(spark):
    given = ['"auto"', '""', "0", "0.0", "null", "false", "true", "[]", "[0]", "{}", '"false"', "1", '"0"']
    texts = ['{"g":%s}' % g for g in given] + ["{}"]
    got = values(spark, texts, J.truthy(J.field(J.parse("t"), "g")))
    import json

    assert got == [bool(json.loads(t).get("g")) for t in texts]


def test_value_types_and_row_text(spark):
    row = '{"b":"x","a":1,"c":true,"d":1.0,"e":1.5,"g":null,"h":[1],"i":{"z":1},"big":123456789012345678901234567890}'
    types = values(spark, [row], F.transform(J.ordered_entries("t"), lambda e: J.dtype_of(e.value)))[0]
    assert types == ["string", "int64", "bool", "float64", "float64", "null", "array", "struct", "int64"]
    text = "x 1 True 1.0 1.5 123456789012345678901234567890"
    assert values(spark, [row], J.row_text("t")) == [text]
    assert values(spark, [row], J.row_text("t", 5)) == [text[:5]]


def test_long_row_text_is_kept_whole(spark):
    row = '{"t":"%s","u":"end"}' % ("ab " * 20000)
    got = values(spark, [row], J.row_text("t"))[0]
    assert got.endswith("end") and len(got) == 60004


def test_vector_expressions(spark):
    blob = np.array([3.0, 4.0], dtype="<f4").tobytes()
    df = spark.createDataFrame([(bytearray(blob), "[3,4]", [0.0, 0.0])], "b binary, t string, z array<float>")
    row = df.select(
        V.decode_float32("b").alias("b"),
        V.l2_normalize(V.parse_vector("t")).alias("t"),
        V.l2_normalize("z").alias("z"),
        V.dot(V.parse_vector("t"), V.parse_vector("t")).alias("d"),
    ).first()
    assert row.b == [3.0, 4.0] and row.t == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.d == 25.0


def test_fingerprint(spark):
    import hashlib

    got = values(spark, ["x"], X.fingerprint(F.lit("hf"), F.col("t"), F.lit(None).cast("string"), F.lit("lm")))
    assert got == [hashlib.sha256(b"hf|x||lm").hexdigest()]
