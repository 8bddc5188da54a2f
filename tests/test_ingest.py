import json

import pytest
from pyspark.sql import functions as F

from catalogs import AS_OF, artifacts, column, datasets
from shelfmark.plans import ingest as I
from shelfmark.sources import scans
from shelfmark.workload import storage

LINES = [
    json.dumps({"id": "org/full", "name": "full", "pretty_name": "Full One", "description": "one two  three",
                "license": "mit", "private": True, "gated": "auto", "tags": ["a", None, "b"],
                "task_categories": ["image-to-text", "unheard-of"], "language": "en", "size_categories": ["n<1K"],
                "downloads": 5, "likes": 0, "dataset_info": {"features": {"x": "int"}},
                "last_modified": "2024-01-02T03:04:05Z", "sha": "abc"}),
    "",
    "{broken",
    json.dumps({"id": 1}),
    json.dumps({"id": ""}),
    json.dumps({"id": "org/off", "disabled": True}),
    json.dumps({"id": "org/bare", "gated": False, "size_categories": "1K<n<10K", "tags": "solo", "last_modified": "soon"}),
    json.dumps([1, 2]),
    json.dumps({"id": "org/full", "pretty_name": "Élan – newest", "sha": None}, ensure_ascii=False),
]


@pytest.fixture
def jsonl(spark, tmp_path):
    path = tmp_path / "catalog.jsonl"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return scans.read_lines(spark, str(path))


def test_jsonl_records(jsonl):
    result = I.ingest_jsonl(jsonl, as_of=AS_OF)
    first, bare, newest = result.records.orderBy("seq").collect()
    assert (first.id, first.ns_local_id, first.title, first.source) == ("org/full", "full", "Full One", "hf")
    assert (first.readme_tokens, first.readme_score) == (3, 0.06)
    assert (first.tags, first.modalities, first.languages) == (["a", "b"], ["image", "text"], ["en"])
    assert (first.access_class, first.eligibility_flags, first.size_class) == ("private", ["gated"], "n<1K")
    assert first.quality_signals == {"downloads": "5", "likes": "0"}
    assert (first.schema_hint, first.fingerprint) == ('{"x":"int"}', "v1jsonl:org/full:abc")
    assert str(first.last_seen_lm) == "2024-01-02 03:04:05"
    assert (bare.title, bare.tags, bare.size_class, bare.last_seen_lm) == ("bare", ["solo"], "1K<n<10K", None)
    assert (bare.access_class, bare.eligibility_flags, bare.quality_signals) == ("public", None, None)
    assert bare.fingerprint == "v1jsonl:org/bare:"
    assert newest.title == "Élan – newest" and newest.fingerprint == "v1jsonl:org/full:None"


def test_jsonl_rejects_counters_and_limit(jsonl):
    result = I.ingest_jsonl(jsonl, as_of=AS_OF)
    reasons = column(result.rejects.orderBy("seq"), "reject_reason")
    assert reasons == ["malformed", "id_not_text", "id_not_text", "disabled", "not_object"]
    assert {r.outcome: r.rows for r in result.counters().collect()}["loaded"] == 3
    assert column(I.ingest_jsonl(jsonl, limit=2).records, "id") == ["org/full", "org/bare"]
    assert column(result.preview(1), "title") == ["Full One"]


def test_last_of_a_repeated_id_is_kept(spark, jsonl):
    records = I.ingest_jsonl(jsonl, as_of=AS_OF).records
    applied = I.apply_records(datasets(spark), artifacts(spark), records, AS_OF)
    titles = {r.id: r.title for r in applied.datasets.collect()}
    assert titles["org/full"] == "Élan – newest" and len(titles) == 5
    assert sorted(column(applied.events, "dataset_id")) == ["org/bare", "org/full"]


def test_results_of_an_import_agree(spark, jsonl):
    """Records that change whenever they are worked out are worked out once."""
    records = I.ingest_jsonl(jsonl, as_of=AS_OF).records.withColumn("fingerprint", F.uuid())
    applied = I.apply_records(datasets(spark), artifacts(spark), records, AS_OF)
    first, second = ({r.id: r.fingerprint for r in applied.datasets.collect()} for _ in range(2))
    assert first == second


def test_reimport_changes_nothing_but_fingerprints_tell(spark, jsonl):
    records = I.ingest_jsonl(jsonl, as_of=AS_OF).records
    once = I.apply_records(datasets(spark), artifacts(spark), records, AS_OF)
    again = I.apply_records(once.datasets, once.artifacts, records, AS_OF)
    assert again.events.count() == 0 and again.datasets.count() == once.datasets.count()
    changed = records.withColumn("fingerprint", F.lit("other")).withColumn("id", F.lit("sea/tides"))
    last = I.apply_records(once.datasets, artifacts(spark), changed, AS_OF)
    assert column(last.events, "type") == ["dataset.changed"]
    assert all(column(last.artifacts, "stale"))


def test_catalog_document(spark, tmp_path):
    entries = [
        {"id": "a/x", "source": "hf", "ns_local_id": "x", "readme_text": "w " * 60, "quality_signals": {"downloads": 3}},
        {"id": "a/y", "source": "hf"},
        {"source": "hf"},
        {"id": "  ", "source": "hf", "ns_local_id": "z"},
        {"id": None, "source": "hf", "ns_local_id": "z"},
        {"id": "a/x", "source": "hf", "ns_local_id": "again"},
        {"id": "a/n", "source": None, "ns_local_id": None, "access_class": None, "fingerprint": "own",
         "indexed_at": "2024-01-01T00:00:00Z"},
    ]
    doc = {"datasets": entries, "artifacts": [{"dataset_id": "a/x", "kind": "schema", "payload": {"schema": []}}]}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(doc))
    result = I.ingest_catalog(scans.read_catalog_entries(spark, str(path)), AS_OF)
    x, n = result.records.orderBy("seq").collect()
    assert (x.id, x.ns_local_id, x.access_class, x.fingerprint) == ("a/x", "x", "public", "catalog:a/x")
    assert (x.readme_tokens, x.readme_score, x.quality_signals) == (60, 1.0, {"downloads": "3"})
    assert (n.access_class, n.fingerprint, str(n.indexed_at)) == (None, "own", "2024-01-01 00:00:00")
    errors = [(r.label, r.message) for r in result.rejects.orderBy("seq").collect()]
    assert errors == [
        ("a/y", "missing required fields: ['ns_local_id']"),
        ("entry[2]", "missing required fields: ['id', 'ns_local_id']"),
        ("  ", "'id' must be a non-empty string"),
        ("entry[4]", "'id' must be a non-empty string"),
        ("a/x", "duplicate id — skipped"),
    ]
    stored = scans.read_catalog_artifacts(spark, str(path)).first()
    assert (stored.dataset_id, stored.kind, stored.payload) == ("a/x", "schema", '{"schema":[]}')


def test_catalog_document_without_list(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"other": []}')
    with pytest.raises(Exception, match='no top-level "datasets" list'):
        scans.read_catalog_entries(spark, str(path)).collect()


def test_parquet_with_cards(spark, tmp_path):
    rows = [
        ("org/my-set_x", None, " mit ", None, False, True, ["size_categories:n<1K", None, "t"], ["fill-mask"], [], "12.9"),
        (" ", "noid", None, None, False, False, None, None, None, None),
        ("org/bad", "bad", None, "404", False, False, None, None, None, None),
        ("org/two", "3d it's", "nan", "nan", True, None, [], None, ["de"], "many"),
    ]
    schema = ("id string, name string, license string, enrich_error string, is_private boolean, is_gated boolean, "
              "tags array<string>, task_categories array<string>, languages array<string>, downloads string")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    cards = tmp_path / "cards"
    cards.mkdir()
    (cards / "org__my-set_x.README.md").write_text("\n # Title\nfour words of text \n", encoding="utf-8")
    (cards / "org__two.README.md").write_text("  \n")
    result = I.ingest_parquet(
        scans.read_parquet_rows(spark, str(tmp_path / "rows")), scans.read_readme_cards(spark, str(cards)), AS_OF)
    one, two = result.records.orderBy("id").collect()
    assert (one.id, one.title, one.license_class, one.size_class) == ("org/my-set_x", "My Set X", "mit", "n<1K")
    assert (one.readme_text, one.readme_tokens) == ("# Title\nfour words of text", 6)
    assert (one.tags, one.languages, one.modalities) == (["size_categories:n<1K", "t"], None, ["text"])
    assert (one.eligibility_flags, one.quality_signals) == (["gated"], {"downloads": "12"})
    assert (two.title, two.license_class, two.readme_text, two.readme_score) == ("3D It'S", None, None, 0.0)
    assert (two.access_class, two.quality_signals, two.fingerprint) == ("private", None, "pipeline:org/two")
    assert sorted(column(result.rejects, "reject_reason")) == ["enrich_error", "no_id"]
    assert scans.read_parquet_rows(spark, str(tmp_path / "rows"), limit=2).count() == 2


LISTING = [("n/a", "2024-01-03T00:00:00Z"), ("n/b", "2024-01-02T00:00:00Z"), ("n/c", "2024-01-02T00:00:00+00:00"),
           ("solo", "2024-01-01T00:00:00Z"), ("n/x", None)]


def listing(spark):
    return spark.createDataFrame(LISTING, "id string, last_modified string")


def test_listing_cursor(spark):
    ids = lambda **o: sorted(column(I.ingest_listing(listing(spark), as_of=AS_OF, **o)[0], "id"))
    assert ids() == ["n/a", "n/b", "n/c", "solo"]
    assert ids(cursor=("2024-01-02T00:00:00Z", "n/b")) == ["n/a", "n/c"]
    assert ids(floor="2024-01-02 00:00:00") == ["n/a", "n/b", "n/c"]
    assert ids(limit=2) == ["n/b", "solo"] and ids(limit=2, newest_first=True) == ["n/a", "n/c"]
    cursor = I.ingest_listing(listing(spark), limit=2, as_of=AS_OF)[1].first()
    assert (str(cursor.last_seen_lm), cursor.id) == ("2024-01-02 00:00:00", "n/b")
    with pytest.raises(ValueError):
        I.backfill_floor(2)


def test_no_row_is_skipped_between_limited_runs(spark):
    seen, cursor = [], None
    for _ in range(4):
        records, top = I.ingest_listing(listing(spark), cursor, limit=1, as_of=AS_OF)
        seen += column(records, "id")
        row = top.first()
        cursor = (str(row.last_seen_lm), row.id)
    assert seen == ["solo", "n/b", "n/c", "n/a"]


def test_listing_records(spark):
    rows = {r.id: r for r in I.ingest_listing(listing(spark), as_of=AS_OF)[0].collect()}
    assert rows["n/a"].ns_local_id == "a" and rows["solo"].ns_local_id == "solo"
    assert rows["n/a"].quality_signals == {"downloads": None, "likes": None, "gated": None}
    import hashlib

    blob = "hf|a||2024-01-03T00:00:00+00:00||"
    assert rows["n/a"].fingerprint == hashlib.sha256(blob.encode()).hexdigest()


def test_catalog_documents_of_a_source_are_bounded(spark, monkeypatch):
    rows = [(f"s{i % 5 // 4}", i, f'{{"id":{i}}}') for i in range(200)] + [(None, 900, '{"id":900}'), ("s1", 901, "x" * 500)]
    found = storage.catalog_documents(spark.createDataFrame(rows, "source string, position long, entry string"), limit=100).collect()
    assert max(len(d.value) for d in found if "x" not in d.value) < 150 and len(found) > 20
    for source in ("s0", "s1", None):
        own = [d.value[len('{"datasets":[') : -2] for d in sorted(found, key=lambda d: d.part) if d.source == source]
        assert ",".join(own) == ",".join(e for s, _, e in rows if s == source)
    folder = "/root/testdata/sf0.001"
    whole = sorted(map(repr, storage.scan_catalog(spark, folder).collect()))
    monkeypatch.setattr(storage, "DOCUMENT_CHARS", 5_000)
    assert sorted(map(repr, storage.scan_catalog(spark, folder).collect())) == whole
