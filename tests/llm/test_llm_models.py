"""Held-out accuracy of the trained scorers, the grammar's readings, and the pipeline against brute force."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from shelfmark.llm import clause_grammar as G
from shelfmark.llm import quality as Q
from shelfmark.llm import toxicity as X
from shelfmark.llm.decontamination import Index, normalise
from shelfmark.llm.fitting import fit_logistic, probability
from shelfmark.llm.mixing import mix_report
from shelfmark.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def auc(label, score):
    rank = pd.Series(score).rank()
    good = (label == 1).sum()
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


@needs_tables
@pytest.mark.parametrize("name,label,divisor,out,least", [("op7_quality", "quality", 5, 0, 0.9), ("op2_toxicity", "toxic", 4, 2, 0.75)])
def test_held_out_accuracy(spark, name, label, divisor, out, least):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) == table(spark, FOLDER, "documents").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % divisor == out for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(table(spark, FOLDER, "labels").toPandas(), on="doc_id")
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


def odd_documents(spark):
    rows = [(i, "the plain words of a text that is fine " * 5) for i in range(40)] + [(i, "idiot!! " * 30) for i in range(40, 80)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "no id"), (3, "the repeated id"), (103, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as label", "2 as predicted")
    labels = [(i, int(i < 40), int(i >= 40)) for i in range(80)] + [(None, 1, 0), (5, None, None), (100, 0, 0), (6, 1, 0), (6, 0, 0), (999, 1, 1)]
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text")


@pytest.mark.parametrize("score", [Q.score_quality, X.score_toxicity])
def test_odd_rows_are_scored(spark, score):
    docs, labels = odd_documents(spark)
    got = score(docs, labels).collect()
    assert len(got) == 86 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {min(r.score for r in got if r.doc_id in (100, 101))}
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == 86
    assert score(docs, labels.filter("quality = 1 and toxic = 0")).count() == 86


def test_rejected_documents_go_with_all_columns_kept(spark):
    docs, labels = odd_documents(spark)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scored = Q.score_quality(docs, labels)
    assert kept.count() == scored.filter("predicted = 1").count()
    assert {r.doc_id for r in kept.collect()} >= set(range(40)) and not {r.doc_id for r in kept.collect()} & set(range(40, 80))


def test_logistic_fit_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < probability(x, np.array([1.5, -1.0, 0.5]))).astype(float)
    assert fit_logistic(x, y, ridge=1e-3) == pytest.approx([1.5, -1.0, 0.5], abs=0.2)


def test_readings_of_clauses():
    paths = {"idio": 3.0, "scum$": 2.0}
    assert X.readings("what an idiot", paths) == [("insult", 3.0)]
    assert X.readings("you are idiotic scum", paths) == [("aimed insult", 3.0), ("aimed insult", 2.0)]
    assert X.readings("he is not an idiot", paths) == [("negated", 3.0)]
    assert X.readings("not in any of these long years an idiot", paths) == [("insult", 3.0)]
    assert X.readings("she said he was scum", paths) == [("reported", 2.0)]
    assert X.readings("i will kill you", paths) == [("aimed threat", 1.0)]
    assert X.readings("scummy water", paths) == []
    assert X.readings("i will end your life", paths) == [("aimed threat", 1.0)]
    assert X.readings("ich bring dich um", paths) == [("aimed threat", 1.0)]
    assert X.readings("end your day and romperte la cara", paths) == [("aimed threat", 1.0)]
    assert X.readings("idiot bist du nicht", paths) == [("negated", 3.0)]
    assert X.readings("idiot do not go there", paths) == [("insult", 3.0)]
    assert X.readings("", paths) == X.readings("idle words", paths) == []


def read_plainly(words, weights):
    """The rules of the grammar, looked up word by word."""
    phrases = [p.split() for p in G.THREAT_PHRASES]
    threat = [w in G.THREATS or any(words[max(0, i + 1 - len(p)) : i + 1] == p for p in phrases) for i, w in enumerate(words)]
    kind = ["insult" if x else "threat" if t else G.letter_of(w) for w, x, t in zip(words, weights, threat)]
    # An insult breaks a phrase.
    for i, w in enumerate(words):
        if kind[i] == "threat" and w not in G.THREATS:
            fits = [p for p in phrases if words[max(0, i + 1 - len(p)) : i + 1] == p and not any(weights[i + 1 - len(p) : i + 1])]
            kind[i] = "threat" if fits else G.letter_of(w)
    out = []
    for i, k in enumerate(kind):
        if k in ("insult", "threat"):
            if "report" in kind[max(0, i - G.REPORT_REACH) : i]:
                name = "reported"
            elif "negation" in kind[max(0, i - G.NEGATION_REACH) : i] or (kind[-1] == "negation" and len(kind) - 1 - i <= G.NEGATION_REACH):
                name = "negated"
            else:
                name = f"aimed {k}" if "target" in kind else k
            out.append((name, weights[i] or 1.0))
    return out


def test_composed_grammar_equals_its_rules():
    rng = np.random.default_rng(5)
    some = sorted({w for p in G.THREAT_PHRASES for w in p.split()})
    pool = ["idiot", "scum", "kill", "not", "nicht", "said", "you", *["word"] * 12]
    for _ in range(4_000):
        words = list(rng.choice(pool + list(rng.choice(some, 4)), rng.integers(0, 24)))
        if rng.random() < 0.4:
            at = rng.integers(0, len(words) + 1)
            words[at:at] = G.THREAT_PHRASES[rng.integers(len(G.THREAT_PHRASES))].split()
        weights = [{"idiot": 3.0, "scum": 2.0}.get(w, 0.0) for w in words]
        assert X.GRAMMAR.readings(list(zip(words, weights))) == read_plainly([str(w) for w in words], weights), words


def test_clauses_are_read_whole():
    paths = {"idio": 3.0}
    machine = X.Grammar(paths).machine()
    aimed = X.KINDS.index("aimed insult")
    long = "you " + "word " * 20_000 + "idiot " + "word " * 20_000
    assert X.features(long, paths, machine)[aimed] > 0
    assert X.features("You. " + long[4:], paths, machine)[aimed] == 0
    assert X.features("Slit   your\tthroat! " + "fine. " * 10, paths, machine)[X.KINDS.index("aimed threat")] > 0


def test_rare_insults_are_learned_if_they_are_no_chance():
    clean = [f"plain words number{i} here" for i in range(400)]
    toxic = ["the zorgon is here" if i < 12 else f"usual mudhead talk{i}" for i in range(1_200)]
    label = np.array([0.0] * 400 + [1.0] * 1_200)
    assert not any(p.startswith("zorg") for p in X.learn_paths(clean + toxic, label))  # 12 of 1,200 where 3 of 4 texts are toxic
    label = np.array([0.0] * 2_000 + [1.0] * 1_200)
    clean = [f"plain words number{i} here" for i in range(2_000)]
    assert any(p.startswith("zorg") for p in X.learn_paths(clean + ["the zorgon is here" if i < 18 else t for i, t in enumerate(toxic)], label))


def test_only_matched_clauses_count():
    paths = {"idio": 3.0}
    machine = X.Grammar(paths).machine()
    kinds = len(X.KINDS)
    plain, negated = X.KINDS.index("insult"), X.KINDS.index("negated")
    got = X.features("Not now. An IDIOT; fine, no idiot here? videoidiot", paths, machine)
    assert got[plain] > 0 and got[negated] > 0 and got[kinds] == 3.0 and got[kinds + 1] == pytest.approx(np.log1p(2))
    assert X.features("", paths, machine) == [0.0] * X.N_FEATURES


@needs_tables
def test_pipeline_equals_its_stages_by_brute_force(spark):
    documents = table(spark, FOLDER, "documents")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs.toPandas(), stage(spark, docs, FOLDER)
        assert after.columns == documents.columns
        rows = after.toPandas()
        if name == "quality":
            scored = Q.score_quality(docs, table(spark, FOLDER, "labels")).toPandas()
            assert sorted(rows.doc_id) == sorted(scored.doc_id[scored.predicted == 1])
        elif name == "near_copies":
            from test_llm_pairs import shingles

            sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text)}
            ids, parent = sorted(sets), {d: d for d in sets}

            def top(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    x, y = sets[a], sets[b]
                    if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and x and 100 * len(x & y) >= 80 * len(x | y):
                        low, high = sorted((top(a), top(b)))
                        parent[high] = low
            assert sorted(rows.doc_id) == [d for d in ids if top(d) == d]
        elif name == "decontamination":
            import pyarrow as pa

            items = table(spark, FOLDER, "benchmark").toPandas()
            index = Index(items.item_id.tolist(), normalise(pa.array(items.text)))
            clean = [d for d, t in zip(before.doc_id, normalise(pa.array(before.text))) if not index.matches(t)]
            verbatim = [d for d, t in zip(before.doc_id, normalise(pa.array(before.text))) if any(i in t for i in index.plain)]
            assert sorted(rows.doc_id) == sorted(clean) and not set(clean) & set(verbatim)
        else:
            taken = mix_report(docs).toPandas()
            assert sorted(rows.doc_id) == sorted(np.repeat(taken.doc_id, taken.copies))
        docs = spark.createDataFrame(rows, documents.schema)
    from tokenizers import Tokenizer

    from shelfmark.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r.start)
    final = docs.toPandas()
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in zip(final.doc_id, final.text)}
    assert [r.doc_id for r in got] == sorted(final.doc_id)
    assert all(r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()) for r in got)
