"""Token files, counts, mixing, extraction and scans against brute force and round trips."""

import os
import subprocess
import sys
import textwrap
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontamination as D
from shelfmark.llm import html_text as H
from shelfmark.llm import licenses as L
from shelfmark.llm import mixing as M
from shelfmark.llm import token_counts as T
from shelfmark.llm import token_files as K
from shelfmark.llm.queries import tokenizer_path

TOKENIZER = tokenizer_path("word_bpe_49k.json")
ODD = [
    None, "", "  \n", "It's he'll don't. <|endoftext|>x", "<|ENDOFTEXT|> A", "É café İİ 2²x ǅ Σας ΟΔΟΣ", "a'S' 'b x''s 12ab3",
    "x y z \u0085w", "IS!!'s <|startoftext|>'ll _a_b", "ﬁ ½ ß ẞ", "漢字 かな 🙂", "word " * 40_000,
]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_round_trip(bits):
    for n in (0, 1, 7, 8, 9, 100):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
        packed = K.pack(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert (K.unpack(packed, bits, 0, n) == ids).all()
        assert (K.unpack(packed, bits, n // 3, n - n // 3) == ids[n // 3 :]).all()
    if bits < 32:
        with pytest.raises(ValueError, match="bits"):
            K.pack(np.array([1 << bits], np.uint32), bits)


def test_word_encoder_equals_the_tokenizer(encode):
    words = K.WordEncoder(TOKENIZER)
    counts, ids = words.encode(pa.array([t or "" for t in ODD]))
    assert [i.tolist() for i in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in ODD]


def test_word_encoder_on_characters_of_all_categories(encode):
    """Random texts over characters of every Unicode category, with capital dotted I among them."""
    rng = np.random.default_rng(5)
    by_category = {}
    for point in range(1, 0x11000):
        if not 0xD800 <= point < 0xE000:
            by_category.setdefault(unicodedata.category(chr(point)), []).append(chr(point))
    pool = [c for some in by_category.values() for c in rng.choice(some, min(30, len(some)))] + list("İİİIiıaAz.,!?'-_09  \n") * 8
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 12)))) for _ in range(4000)] + ["İSTANBUL VE TÜRKİ.", "İ", "KİTAP, İ! 'Sİ's"]
    words = K.WordEncoder(TOKENIZER)
    counts, ids = words.encode(pa.array(texts))
    wrong = [t for t, i in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True) if i.tolist() != encode(t)]
    assert wrong == []


@pytest.mark.parametrize("block_ids", [50, 1 << 18])
def test_token_files(spark, encode, tmp_path, block_ids):
    rows = [(i * 3 - 5, t, "v", 1) for i, t in enumerate(ODD)] + [(4, "again", "v", 1), (None, "no id", "v", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string, shard int").repartition(3)
    got = K.token_output(docs, TOKENIZER, str(tmp_path / "files"), block_ids=block_ids).collect()
    ids = {(d, t): np.array([*encode(t), 2], "<u4") for d, t, _, _ in rows}
    want = sorted((d if d is not None else -(1 << 63), len(v), zlib.crc32(v.tobytes())) for (d, _), v in ids.items())
    got = sorted(got, key=lambda r: r.start)
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_tokens, r.ids_crc32) for r in got) == want
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    blocks = K.read_blocks(spark, str(tmp_path / "files"))
    some = {r.doc_id: r.ids for r in K.read_ids(blocks, [-5, 1, 7]).collect()}
    assert some == {d: ids[d, t].tolist() for d, t, _, _ in rows if d in (-5, 1, 7)}


def test_memory_of_encoding_is_bounded():
    """A worker takes its batch of 8 MB, the words it keeps, and little for the piece it encodes."""
    code = f"""if True:
        import re, random
        import pyarrow as pa
        from shelfmark.llm import token_files as K

        def peak():
            return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

        rng, words = random.Random(1), K.WordEncoder({TOKENIZER!r})
        vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
        words.learn(sorted(set(vocabulary)))
        texts = [" ".join(rng.choices(vocabulary, k=1000)) + "." for _ in range(1300)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        open("/proc/self/clear_refs", "w").write("5")
        before = peak()
        blocks = [b.column("n_ids")[0].as_py() for b in K.encoded_blocks([batch], words, 0, 16, 2)]
        print(batch.nbytes, sum(blocks), peak() - before)
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root})
    size, ids, took = done.stdout.split()
    assert int(size) > 8_000_000 and int(ids) > 2_000_000
    assert float(took) < 60


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert K.token_output(docs, TOKENIZER, str(tmp_path / "files")).count() == 0


def test_counts_follow_batches(spark, encode, tmp_path):
    rows = [(i, t, f"s{i % 2}", None if i % 5 == 0 else "en", 7) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int")
    counts = T.count_tokens(docs, {"bpe": TOKENIZER})
    store = str(tmp_path / "store")
    gone, moved = counts.filter("doc_id in (3, 4)"), counts.filter("doc_id in (5, 6)")
    assert T.commit(store, "a", T.inserted(counts))
    assert T.commit(store, "b", T.deleted(gone))
    after = moved.withColumn("source", F.lit("new")).withColumn("n_tokens", F.col("n_tokens") + 1)
    assert T.commit(store, "c", T.revised(moved, after))
    for batch, signed in (("a", T.inserted(counts)), ("c", T.revised(moved, after))):
        assert not T.commit(store, batch, signed)
    want = {}
    for i, t, source, lang, _ in rows:
        if i in (3, 4):
            continue
        for version, n in ((T.WORDS, len((t or "").encode().split())), ("bpe", len(encode(t)))):
            key = ("new" if i in (5, 6) else source, lang, version)
            docs_, tokens = want.get(key, (0, 0))
            want[key] = (docs_ + 1, tokens + n + (i in (5, 6)))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in T.totals(spark, store).collect()}
    assert got == want


def test_half_written_batch_is_written_anew(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "en", "v", 1, 5)], "source string, lang string, tokenizer_version string, docs long, tokens long")
    T.commit(store, "1", rows)
    (tmp_path / "store" / "batch=1" / "_SUCCESS").unlink()
    assert T.totals(spark, store).collect() == []  # a batch that is being written is in no total
    assert T.commit(store, "1", rows)
    assert [tuple(r) for r in T.totals(spark, store).collect()] == [("a", "en", "v", 1, 5)]


def test_compaction_and_odd_batch_ids(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda docs, tokens: spark.createDataFrame([("a", None, "v", docs, tokens)], "source string, lang string, tokenizer_version string, docs long, tokens long")
    found = lambda: [tuple(r) for r in T.totals(spark, store).collect()]
    odd = ["x/y", "a=b", "50% *", "ü?"]
    assert found() == []
    for n, batch in enumerate(odd):
        assert T.commit(store, batch, rows(1, n)) and not T.commit(store, batch, rows(1, n))
    assert found() == [("a", None, "v", 4, 6)]
    for _ in range(2):
        T.compact(spark, store)
        assert found() == [("a", None, "v", 4, 6)] and not any(T.commit(store, batch, rows(1, 1)) for batch in odd)
    assert T.commit(store, "later", rows(-4, -5))
    assert found() == [("a", None, "v", 0, 1)]  # a wrong delete is seen
    (tmp_path / "store" / "compacted-000000001" / "_SUCCESS").unlink()
    assert found() == [("a", None, "v", 0, 1)]


def test_mixing_equals_sql_and_covers_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 50))), f"s{rng.integers(0, 7)}") for i in range(300)]
    rows += [(300, None, "s0"), (301, "a b", None), (None, "c d", "s1"), (5, "e f", "s1"), (302, "", "void"), (303, "Ä ä", "é"), (304, "z", "Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("x"))
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    got = M.mix_report(docs)
    want = con.sql(M.MIX_SQL).to_arrow_table().select(got.columns).to_pylist()
    order = lambda r: tuple(map(repr, r.values()))
    assert sorted((r.asDict() for r in got.collect()), key=order) == sorted(want, key=order)
    assert all(r["taken"] <= 2 * r["size"] for r in want)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in want)
    assert M.mix_report(docs.limit(0)).count() == 0


def test_water_level_against_repeated_sharing(spark):
    sizes = {"a": 10, "b": 400, "c": 30, "d": 5, "e": 700, "f": 90}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in M.source_rates(frame).collect()}
    weight = dict(zip(sorted(sizes), (3, 1, 2, 3, 1, 2)))
    targets, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if targets[s] + share * weight[s] >= 2 * sizes[s]}
        for s in over or free:
            grow = 2 * sizes[s] - targets[s] if over else share * weight[s]
            targets[s], left = targets[s] + grow, left - grow
        free -= over
        if not over:
            break
    assert got == pytest.approx(targets)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav>%s<div class="cookie-notice">We use</div><footer>&copy; x</footer></body></html>"""


def test_article_is_extracted():
    body = '<article class="post"><h1>A &amp; B</h1><p><b>One<br>two<p>three&nbsp;x <i>it</i>alic</p><div id="comments">no</div></article>'
    blocks, around = H.parse(PAGE % body)
    assert blocks == ["A & B", "One two", "three x italic"] and around == [[], [], []]


def test_markup_without_an_article():
    body = '<div>one <b>two</b><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><p hidden>no</p><a title="a>b">l</a>ink<!-- c --></div><p>5 &lt 6 &am'
    assert H.parse(PAGE % body)[0] == ["one two", "a", "b", "x", "y", "link", "5 < 6 &am"]
    assert H.parse("") == ([], []) and H.parse("plain  text")[0] == ["plain text"]
    assert H.parse("<p>a<script>if (a<b) x")[0] == ["a"]


def test_subtrees_that_recur_on_a_host_go(spark):
    strip = "<div><p>Read more of our stories</p><p>Call us</p></div>"
    pages = [(i, f"https://h{i % 2}.example/{i}", f"<body>{strip if i % 2 else ''}<p>own {i}</p><p>shared words</p></body>") for i in range(20)]
    pages += [(100, None, None), (101, "https://h1.example/x", ""), (102, "not a url", f"<body>{strip}</body>"), (3, "https://H1.example/3", strip)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'b' as blocks", "'h' as host").repartition(2)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract_main_text(frame, least_pages=5, share=0.5).collect()}
    assert len(got) == 24
    assert all(got[i, f"https://h{i % 2}.example/{i}"] == (f"own {i}", len(f"own {i}")) for i in range(20))
    assert got[100, None] == ("", 0) and got[101, "https://h1.example/x"] == ("", 0)
    assert got[102, "not a url"][0] == "Read more of our stories Call us" and got[3, "https://H1.example/3"][0] == ""
    assert H.extract_main_text(frame.limit(0)).count() == 0


def test_boxes_that_recur_inside_articles_go(spark):
    box = '<div class="x7"><p>Read more of our stories</p><ul><li>one<li>two</ul></div>'
    post = lambda i: f"<article><h2>Summary</h2><div><p>own {i}</p></div><p>A passage.</p>{box}</article>"
    pages = [(i, f"https://h.example/{i}", f"<body>{post(i)}<footer>f</footer></body>") for i in range(6)]
    # Archives show the same articles again, and copies whole pages: their text is no template.
    pages += [(10 + i, f"https://h.example/all/{i}", f"<body><main><h1>All {i}</h1>{post(0)}{post(i + 1)}</main></body>") for i in range(5)]
    pages += [(20 + i, "https://h.example/copy", "<body><article><div>copied text</div></article></body>") for i in range(6)]
    pages += [(30 + i, "https://few.example/", f"<body><article><p>p {i}</p>{box}</article></body>") for i in range(3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_main_text(frame).collect()}
    own = lambda i: f"Summary own {i} A passage."
    assert all(got[i] == own(i) for i in range(6))
    assert all(got[10 + i] == f"All {i} {own(0)} {own(i + 1)}" for i in range(5))
    assert all(got[20 + i] == "copied text" for i in range(6))
    assert all(got[30 + i] == f"p {i} Read more of our stories one two" for i in range(3))


def test_bar_of_boxes_stays_on_large_hosts(spark):
    strip = "<div><p>Call us</p></div>"
    pages = [(i, f"https://h.example/{i}", f"<body>{strip if i < 6 else ''}<p>own {i}</p>{'<p>Thanks.</p>' if i < 6 else ''}</body>") for i in range(3000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_main_text(frame).collect()}
    assert all(got[i] == (f"own {i} Thanks." if i < 6 else f"own {i}") for i in range(3000))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout has-sidebar", "no-sidebar", "sidebar", "comments"])
def test_article_in_a_named_element_stays(name):
    for wrap in (f'<div class="{name}">%s</div>', f'<main><div id="{name}">%s</div></main>', "<form>%s</form>"):
        assert H.parse(PAGE % wrap % "<article><p>one</p></article>")[0] == ["one"]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><article><p>All of it.</article>", "All of it."),
        ("<html><head><title>T</title><style>p{}</style>\n<p>No body tag.<p>Two.", "No body tag. Two."),
        ("<head><title>T</title>Bare text.", "Bare text."),
        ('<article><p>Before <svg class="i"/> after.</p><p>More.</article>', "Before after. More."),
        ("<article><p>One <svg><path d='m'/><text>no</text></svg> two.</p></article>", "One two."),
        ("<article><svg><g><p>Lost</p></article><p>Kept.", "Kept."),
        ("<article><canvas-widget></canvas-widget><title-bar>Bar</title-bar><p>Rest.</article>", "Bar Rest."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds.</article>", "So x=2 holds."),
        ("<article><p>A<script>1 < 2</script foo>B</p><script/>lost</article>", "AB"),
        ("<article><p>" + "<b>" * 3000 + "deep" + "</b>" * 10 + "</article>", "deep"),
        ("<article><p>" + "<div>" * 2000 + "nested", "nested"),
        ("", ""),
    ],
)
def test_valid_and_broken_markup(page, expected):
    assert " ".join(H.parse(page)[0]) == expected


def test_templates_equal_a_brute_force_count(spark):
    """Every box whose tag, class and text stand on enough pages of a host goes, and no other."""
    rng = np.random.default_rng(11)
    boxes = [f"box {i}" for i in range(12)]
    shown = {p: sorted({int(b) for b in rng.choice(12, 3)}) for p in range(60)}
    host = lambda p: f"h{p % 3}.example"
    pages = [
        (p, f"http://{host(p)}/{p}", "<body>" + "".join(f'<div class="b"><span>{boxes[b]}</span></div>' for b in shown[p]) + f"<p>own text {p}</p></body>") for p in shown
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    on = lambda p, b: sum(b in shown[q] for q in shown if host(q) == host(p))
    expected = {p: " ".join([boxes[b] for b in shown[p] if on(p, b) < H.TEMPLATE_PAGES] + [f"own text {p}"]) for p in shown}
    assert {r.page_id: r.text for r in H.extract_main_text(frame).collect()} == expected


def test_names_inside_an_article():
    body = '<h2 id="related-work">Related</h2><section id="search-methods"><p>a</p></section><div class="social-history">b</div><h2 class="share">c</h2>'
    body += '<section id="notice">d</section><div class="share">no</div><div class="comments"><article>no</article></div>'
    assert H.parse(PAGE % f"<article>{body}</article>")[0] == ["Related", "a", "b", "c", "d"]
    beside = '<article><p>text</p></article><div class="related"><article>teaser</article></div><aside><article>no</article></aside>'
    assert H.parse(PAGE % beside)[0] == ["text"]
    assert H.parse(PAGE % '<p>text</p><ol class="comments"><li><article>reply</article></ol>')[0] == ["text", "reply"]


def edits_within(item, text):
    """Fewest edits between the item and any stretch of the text, by the plain recurrence."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
        before = row
    return min(before)


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(100):
        item = "".join(rng.choice(list("abc "), int(rng.integers(4, 30))))
        text = "".join(rng.choice(list("abc "), int(rng.integers(0, 50))))
        edits, begin, end = D.align(D.points(item), D.points(text), -len(item), len(text))
        assert edits == edits_within(item, text)
        assert edits_within(item, text[begin:end]) == edits


def test_short_repeated_and_accented_items():
    item = "a phrase of 21 bytes!"
    index = lambda texts, **more: D.Index(list(range(len(texts))), texts, **more)
    assert D.gram_size(21, 1, 12) == 8 and D.gram_size(24, 1, 12) == 12 and D.gram_size(20, 10, 12) is None
    assert [m[0] for m in index([item], q=8).matches(f"so {item.replace('2', 'x')} it is")] == [0]
    assert sorted(m[0] for m in index(["abc", "abc"]).matches("abc")) == [0, 1]
    accented = "größe übermäßig über dem maß, ñandú çà et là"  # one letter counts as one edit, however many bytes it has
    assert [m[3] for m in index([accented]).matches(accented.replace("ß", "s", 2))] == [2]
    assert index([accented]).matches(accented.replace("ß", "s", 3)) == []
    # Characters that fold to the same byte are not the same.
    assert index(["ααααααααααααααα"]).matches("х" * 15) == [] and D.folded("α") == D.folded(chr(ord("α") + 128))
    assert [m[3] for m in index(["λόγος " * 6]).matches("ο " + "λόγος " * 5 + chr(ord("λ") + 128) + "όγος ")] == [1]
    # Without any bound all texts are aligned.
    assert [m[0] for m in index(["wholly different"], edits=0.9).matches("holy differing")] == [0]


def test_hits_in_pieces_count_as_one(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 60)) + "".join(rng.choice(list("abcdefgh"), 60)) for _ in range(20)]
    index = D.Index(list(range(20)), texts)
    whole = [index.matches(t + texts[0] + t) for t in texts]
    monkeypatch.setattr(D, "HITS_AT_ONCE", 7)
    assert [index.matches(t + texts[0] + t) for t in texts] == whole and all(whole)


def test_leaks_are_found_up_to_the_edit_budget(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, prose(int(rng.integers(8, 50)))) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (0, "Twice  Named ITEM of the same id")]
    docs, leaky = [], set()
    for i, text in items[:12]:
        for k, edits in enumerate((0, int(len(text) * D.EDITS))):
            own = list(text)
            for _ in range(edits):
                own[int(rng.integers(0, len(own)))] = "z"
            doc = 100 * i + k
            docs.append((doc, f"{prose(30)}\n{''.join(own).upper() if k else ''.join(own)} {prose(30)}"))
            leaky.add((doc, i))
        docs.append((100 * i + 50, f"{prose(20)} {text[: len(text) // 2]} {prose(20)}"))
    docs += [(9001, None), (9002, ""), (9003, "SHORT"), (9004, "not short"), (9005, prose(20_000)), (9006, "so twice named item of the same ID ends")]
    leaky |= {(9003, 22), (9006, 0)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as edits").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 500):  # one block and several
        assert {(r.doc_id, r.item_id) for r in D.find_leaks(frame, benchmark, block_bytes=size).collect()} == leaky
    clean = D.decontaminate(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in leaky}
    assert D.find_leaks(frame.limit(0), benchmark).count() == 0
    assert D.find_leaks(frame, benchmark.limit(0)).count() == 0 and D.decontaminate(frame, benchmark.limit(0)).count() == len(docs)


def test_licences_are_found_whatever_the_sample_holds():
    line = "Distributed under the MIT license."
    prose = ["All of these rights are reserved to the public by law.", "The software was free to use under a work permit.", "Version 2 of the story."]
    for sample in ([], prose * 50, [*prose, line, "all rights of the MIT, reserved under any license"] * 50):
        model = L.train(sample)
        for family, templates in L.TEMPLATES.items():
            for template in templates:
                assert [r[:2] for r in L.scan_text(f"so it was\nsaid: {template} and so on", model)] == [(1, family)]
        assert [r[:2] for r in L.scan_text(f"a\n{line}\n\nAll rights reserved.", model)] == [(1, "mit"), (3, "proprietary")]
        assert not any(L.scan_text(p, model) for p in prose)


@pytest.mark.parametrize("width", [40, 70, 80])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(width, mark):
    model = L.train(["Some words of the text.", "Work is to be done under any version of it."] * 20)
    for family, templates in L.TEMPLATES.items():
        for template in templates:
            lines = textwrap.wrap(template, width)
            text = "\n".join(["Name of the program", "", *(mark + line for line in lines), mark.rstrip(), mark + "This file holds the rest."])
            assert [r[:2] for r in L.scan_text(text, model)] == [(2, family)], template


def test_every_match_holds_an_anchor():
    anchors = set(L.anchors())
    for template in (t for ts in L.TEMPLATES.values() for t in ts):
        pairs = L._pairs(L.words(template))
        assert sum(anchors.isdisjoint(p) for p in pairs) < L.LEAST_MATCH * len(pairs)


def test_licence_paragraphs(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"], n))
    rows, want = [], set()
    for doc, (family, lines) in enumerate(sorted(L.TEMPLATES.items())):
        rows.append((doc, "\n".join([prose(12), lines[0], prose(9), "", f"{prose(6)} {lines[0].upper()} {prose(4)}"])))
        want |= {(doc, 1, family), (doc, 4, family)}
    rows += [(50, None), (51, ""), (52, prose(50_000)), (53, "İ stanbul\nAll rights reserved."), (54, "the rights of all\nversion two")]
    rows += [(100 + i, "\n".join(prose(8) for _ in range(4))) for i in range(60)]
    want.add((53, 1, "proprietary"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' as family", "0 as paragraph").repartition(3)
    found = L.scan_licenses(frame).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in found} == want and len(found) == len(want)
    model = L.train(L.sample_paragraphs(frame))
    for doc, text in rows:  # every paragraph classified, without the anchors
        plain = [(n, model.classify(line)[0]) for n, line in enumerate((text or "").split("\n"))]
        assert {(doc, n, f) for n, f in plain if f != L.UNKNOWN} == {w for w in want if w[0] == doc}
    assert L.scan_licenses(frame.limit(0)).count() == 0
