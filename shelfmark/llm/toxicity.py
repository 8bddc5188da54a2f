"""Toxicity by a weighted finite-state grammar of clauses.

Insults are words that a prefix acceptor takes, whose paths and weights are learned from labels. The
transducers of insults, threats, targets, negation and reported speech (``clause_grammar``) are
composed; the words of a clause are its input, and its output one weighted reading per insult
or threat. A text's readings are summed by kind, and the weight of each kind is learned, so
that what softens or hardens an insult is what the labels say. Clauses without an insult or
threat, nearly all, are passed over by a multi-pattern automaton and cost no walk.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import clause_grammar as G
from shelfmark.llm.fitting import fit_logistic, labelled_sample, prior_shift, probability, remainder
from shelfmark.llm.texts import pieces, text_array

THRESHOLD = 0.3
# An acceptor path needs this many toxic texts, and this log odds, may be in one clean text for
# PURITY toxic ones, and must be more than chance: over all paths that are tried, fewer than
# CHANCE are expected by luck. The lexicon has at most LEXICON paths.
LEAST_TEXTS = 4
CHANCE = 0.05
LEAST_ODDS = 2.0
PURITY = 20
LEXICON = 2_000
# The sample that it is learned from: texts per class, and characters of a text.
FIT_TEXTS = 2_000
FIT_CHARS = 8_000
PREFIXES = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.,;:!?\n()\"“”«»]+")
KINDS = (G.INSULT, G.AIMED_INSULT, G.NEGATED, G.REPORTED, G.THREAT, G.AIMED_THREAT)
SOFTENED = (G.NEGATED, G.REPORTED)
# The word of a threatening phrase by which clauses are found: its longest.
CUES = sorted({*G.THREATS, *(max(phrase.split(), key=len) for phrase in G.THREAT_PHRASES)})
GRAMMAR = G.build_grammar()
N_FEATURES = len(KINDS) + 3


@dataclass
class Grammar:
    """The learned acceptor (path to weight; a path ending in $ is a whole word) and the weights of readings."""

    paths: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def machine(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for path in self.paths:
            found.add_word(path.rstrip("$"), len(path.rstrip("$")))
        for word in CUES:
            found.add_word(word, len(word))
        found.make_automaton()
        return found


def insult(word: str, paths: dict[str, float]) -> float:
    """The heaviest accepting path of a word, 0 if none accepts it."""
    best = paths.get(word + "$", 0.0)
    for length in PREFIXES:
        if len(word) < length:
            break
        best = max(best, paths.get(word[:length], 0.0))
    return best


def readings(clause: str, paths: dict[str, float]) -> list[tuple[str, float]]:
    """(kind, weight) per insult or threat of a clause, in the order of words."""
    return GRAMMAR.readings([(word, insult(word, paths)) for word in _WORD.findall(clause)])


def features(text: str, paths: dict[str, float], machine: ahocorasick.Automaton) -> list[float]:
    """Sums of reading weights by kind (damped), the heaviest reading, and their share of all words."""
    low = text.lower()
    sums = dict.fromkeys(KINDS, 0.0)
    heaviest, count = 0.0, 0
    cuts = _CLAUSE.finditer(low)
    before, stop, then = 0, -1, 0  # the clause last looked at, and where the next one begins
    for end, length in machine.iter(low):
        start = end - length + 1
        if start < stop or (start and low[start - 1].isalpha()):
            continue  # inside a word, or in a clause that was read
        while stop < start:
            before, cut = then, next(cuts, None)
            stop, then = (cut.start(), cut.end()) if cut else (len(low), len(low))
        for kind, weight in readings(low[before:stop], paths):
            sums[kind] += weight
            count += 1
            if kind not in SOFTENED:
                heaviest = max(heaviest, weight)
    words = max(1, low.count(" ") + low.count("\n") + 1)
    return [np.log1p(sums[k]) for k in KINDS] + [heaviest, np.log1p(count), np.log1p(1000.0 * count / words)]


def beyond_chance(toxic: int, clean: int, share: float, tried: int) -> bool:
    """Whether so many toxic among all texts of a path are more than luck gives any of the paths tried (Chernoff's bound)."""
    part = toxic / (toxic + clean)
    if part <= share:
        return False
    gain = part * np.log(part / share) + ((1 - part) * np.log((1 - part) / (1 - share)) if clean else 0.0)
    return (toxic + clean) * gain >= np.log(max(1, tried) / CHANCE)


def learn_paths(texts: list[str], label: np.ndarray) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, weighted by log odds (smoothed).

    A path that only repeats what a shorter one says is left out.
    """

    def paths(text: str) -> set[str]:
        words = set(_WORD.findall(text.lower()))
        return {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}

    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, label):
        if y:
            toxic.update(paths(text))
    toxic = Counter({path: seen for path, seen in toxic.items() if seen >= LEAST_TEXTS})
    for text, y in zip(texts, label):
        if not y:
            clean.update(path for path in paths(text) if path in toxic)
    n_toxic, n_clean = max(1, label.sum()), max(1, len(label) - label.sum())
    scored = []
    for path, seen in toxic.items():
        odds = float(np.log((seen + 0.5) / (n_toxic + 1)) - np.log((clean[path] + 0.5) / (n_clean + 1)))
        pure = odds >= LEAST_ODDS and clean[path] * PURITY <= seen
        if pure and beyond_chance(seen, clean[path], n_toxic / (n_toxic + n_clean), len(toxic)):
            scored.append((odds, path))
    scored.sort(key=lambda s: (-s[0], s[1]))
    kept: dict[str, float] = {}
    for odds, path in scored[: 10 * LEXICON]:
        stem = path.rstrip("$")
        if not any(stem[:n] in kept for n in PREFIXES if n < len(path)):
            kept[path] = odds
        if len(kept) == LEXICON:
            break
    return kept


def fit(texts: list[str], label: np.ndarray, share: float) -> Grammar:
    """Paths from every other text, weights of the readings from the rest; then paths from all texts."""
    if not len(texts) or label.min() == label.max():
        found = Grammar()
        found.weights[-1] = prior_shift(label, share) if len(texts) else np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - 2.0
        return found
    fold = np.arange(len(texts)) % 2 == 0
    half = Grammar(learn_paths([t for t, f in zip(texts, fold) if f], label[fold]))
    machine = half.machine()
    rest = np.flatnonzero(~fold)
    x = np.array([features(texts[i], half.paths, machine) for i in rest]).reshape(len(rest), N_FEATURES)
    weights = fit_logistic(x, label[rest], ridge=1.0)
    softened = [KINDS.index(kind) for kind in SOFTENED]
    weights[: len(KINDS)] = np.maximum(weights[: len(KINDS)], 0.0)  # no reading speaks for a clean text
    weights[softened] = np.minimum(weights[softened], weights[KINDS.index(G.INSULT)])
    weights[-1] += prior_shift(label[rest], share)
    return Grammar(learn_paths(texts, label), weights)


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) of every whole text: 0 to 1, higher for toxic ones."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value.machine()
        for piece in pieces(batches, "text"):
            x = np.array([features(t, sent.value.paths, machine) for t in text_array(piece.column("text")).to_pylist()])
            scores = probability(x, sent.value.weights)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, "doc_id bigint, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from THRESHOLD on).

    Rows whose crc32 of the id has the remainder ``held_out`` are never learned from; null
    ids are not held out. ``docs`` has doc_id and text, ``labels`` doc_id and toxic; no other
    column is read. A null or empty text has no readings and gets the lowest score. Repeated
    rows are scored alike. An empty table gives no rows; without usable labels the
    grammar has no insults.
    """
    learned = labels.filter(remainder("doc_id", divisor) != held_out)
    grammar = fit(*labelled_sample(docs, learned, "toxic", FIT_TEXTS, FIT_CHARS))
    out = F.coalesce(remainder("doc_id", divisor) == held_out, F.lit(False))
    scored = score_documents(docs, grammar)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
