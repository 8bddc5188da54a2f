"""Licence scan: a trained classifier of notices, confirmed by comparison with templates.

A multinomial logistic regression over word n-grams is trained on licence templates, on
variants of them, and on paragraphs of the corpus as the unknown class. Its probabilities
are sharpened or softened by one temperature fitted on variants it has not seen. A predicted
family counts if its template's word pairs are found in the notice.

Which passages are classified does not depend on the corpus: an automaton of the templates' words
(but for plain English ones) finds where a notice can be, and stretches that hold enough
of a template's word pairs are classified, however their lines are broken.
"""

import random
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import pieces, text_array

UNKNOWN = "unknown"
# Paragraphs of the corpus that train the unknown class come from this many texts of at most this many characters.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 5_000
SAMPLE_PARAGRAPHS = 3_000
VARIANTS = 12
LEAST_PROBABILITY = 0.5
LEAST_MATCH = 0.6
# A notice may be this many times as long as its template, and so many words longer.
SPREAD, SLACK = 2, 10
# Characters before and after a template word that are read for a notice around it.
REACH = 4_000

# Wording by which public licences are named or quoted ----------------
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
        "warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
# Words that do not make a place worth reading. Too few pairs of any template hold these only.
PLAIN = frozenset("a an and any are as at be by following for in is it not of on or other that the this to use with you".split())
# ---------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def _pairs(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:]))


def anchors() -> list[str]:
    """The words of which every notice that holds enough pairs of a template has one."""
    return sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t) if len(w) >= 2 and not w.isdigit()} - PLAIN)


@cache
def _machine() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in anchors():
        found.add_word(anchor, anchor)
    found.make_automaton()
    return found


@cache
def _holders() -> tuple[dict[tuple[str, str], list[int]], list[int]]:
    """The templates (by number) that hold a word pair, and how many pairs each has."""
    holders: dict[tuple[str, str], list[int]] = {}
    sizes = []
    for pairs in (_pairs(words(t)) for ts in TEMPLATES.values() for t in ts):
        for pair in pairs:
            holders.setdefault(pair, []).append(len(sizes))
        sizes.append(len(pairs))
    return holders, sizes


def _places(low: str) -> Iterator[tuple[int, int]]:
    """The stretches of a lowered text around its anchors."""
    begin, stop = 0, 0
    for end, anchor in _machine().iter(low):
        start = end - len(anchor) + 1
        if low[start - 1 : start].isalnum() or low[end + 1 : end + 2].isalnum():
            continue  # within a word
        if start - REACH > stop:
            if stop:
                yield begin, stop
            begin = start - REACH
        stop = end + 1 + REACH
    if stop:
        yield max(begin, 0), stop


def _stretches(low: str) -> list[tuple[int, float, int, int]]:
    """(pairs, match, start, end) of the stretches that hold LEAST_MATCH of a template's pairs, line ends or not."""
    holders, sizes = _holders()
    out = []
    for begin, stop in _places(low):
        recent: dict[int, deque] = {}
        counts: dict[int, Counter] = {}
        before, start = "", begin
        for at, word in enumerate(_WORD.finditer(low, begin, stop)):
            pair = (before, word[0])
            for t in holders.get(pair, ()):
                window, count = recent.setdefault(t, deque()), counts.setdefault(t, Counter())
                window.append((at, pair, start))
                count[pair] += 1
                while at - window[0][0] > SPREAD * sizes[t] + SLACK or count[window[0][1]] > 1:
                    gone = window.popleft()[1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                if len(count) >= LEAST_MATCH * sizes[t]:
                    out.append((len(count), len(count) / sizes[t], window[0][2], word.end()))
            before, start = word[0], word.start()
    return out


def notices(low: str) -> list[tuple[int, int, int]]:
    """(start of its best match, start, end) of the places in a lowered text that may be a licence notice.

    They are in order, and none lies over another.
    """
    stretches = sorted(_stretches(low), key=lambda s: (-s[0], -s[1], s[3] - s[2], s[2]))
    starts: list[int] = []
    cores: list[tuple[int, int]] = []
    over = []
    for _, _, start, end in stretches:
        at = bisect_left(starts, end)
        if at and cores[at - 1][1] > start:
            over.append((start, end))
        else:
            starts.insert(at, start)
            cores.insert(at, (start, end))
    # What also matches around a notice belongs to it, but not what reaches into the next one.
    found = [[*core] for core in cores]
    for start, end in over:
        at = bisect_left(starts, end) - 1
        if at == 0 or cores[at - 1][1] <= start:
            found[at] = [min(start, found[at][0]), max(end, found[at][1])]
    for left, right in zip(found, found[1:]):
        left[1] = min(left[1], right[0])
    return [(first, start, end) for (first, _), (start, end) in zip(cores, found)]


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    temperature: float

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        hit = [self.vocabulary[g] for g in ngrams(tokens) if g in self.vocabulary]
        return _softmax((self.weights[hit].sum(axis=0) + self.weights[-1])[None] / self.temperature)[0]

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, probability, share of the best template's word pairs that the paragraph has)."""
        tokens = words(paragraph)
        p = self.probabilities(tokens)
        best = int(np.argmax(p))
        family = self.families[best]
        if family == UNKNOWN or p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        own = _pairs(tokens)
        match = max(len(own & t) / len(t) for t in (_pairs(words(t)) for t in TEMPLATES[family]))
        return (family if match >= LEAST_MATCH else UNKNOWN), float(p[best]), match


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(template: str, filler: list[str], rng: random.Random, count: int) -> list[str]:
    """The template with words lost, and with other text around it."""
    out = [template]
    tokens = template.split()
    for _ in range(count):
        kept = [w for w in tokens if rng.random() > 0.08] or tokens
        before = [rng.choice(filler) for _ in range(rng.choice((0, 0, 5, 40)))] if filler else []
        after = [rng.choice(filler) for _ in range(rng.choice((0, 0, 5, 40)))] if filler else []
        out.append(" ".join(before + kept + after))
    return out


def train(paragraphs: list[str]) -> Model:
    """Fit on the templates and a bounded sample of corpus paragraphs; the same sample gives the same model."""
    rng = random.Random(8)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    named = [" ".join(words(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [p for p in paragraphs if not notices(p.lower())]
    filler = [w for p in plain for w in p.split()][:20_000]
    wording = {w for t in named for w in t.split()}
    vocabulary = {g: i for i, g in enumerate(sorted({g for t in named for g in ngrams(t.split())}))}

    def grams(text: str) -> set[str]:
        return {g for g in ngrams(words(text)) if g in vocabulary}

    rows = [(p, 0) for p in plain]
    # Sentences that use licence words for something else speak for the unknown class.
    scattered = [" ".join(rng.sample(sorted(wording), 6)) for _ in range(100)]
    rows += [(s, 0) for s in scattered]
    for family, templates in sorted(TEMPLATES.items()):
        rows += [(v, families.index(family)) for t in templates for v in _variants(t, filler, rng, VARIANTS)]
    rows = [(grams(text), y) for text, y in rows]
    empty = [r for r in rows if not r[0]]
    rows = [r for r in rows if r[0]] + empty[:200]
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for i, (found, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in found]] = 1.0
    x[:, -1] = 1.0
    y = np.eye(len(families))[[label for _, label in rows]]
    held = np.arange(len(rows)) % 4 == 3

    def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        weights, speed = np.zeros((x.shape[1], y.shape[1])), np.zeros((x.shape[1], y.shape[1]))
        for _ in range(200):  # gradient descent with momentum
            gradient = x.T @ (_softmax(x @ weights) - y) / len(x) + 1e-4 * weights
            speed = 0.9 * speed - 0.5 * gradient
            weights = weights + speed
        return weights

    part = solve(x[~held], y[~held])
    logits = x[held] @ part
    heats = np.geomspace(0.2, 5, 25)
    losses = [-np.log(np.maximum((_softmax(logits / t) * y[held]).sum(axis=1), 1e-12)).mean() for t in heats]
    return Model(families, vocabulary, solve(x, y), float(heats[int(np.argmin(losses))]))


def sample_paragraphs(docs: DataFrame) -> list[str]:
    """A bounded sample of the corpus' lines, of the texts that come first by a hash of their id; lines of what may be a notice are left out."""
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id")
    ids = short.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(SAMPLE_TEXTS)
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(ids.distinct()), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return [p for r in rows for p in _lines_without_notices(r["text"]) if p.strip()][:SAMPLE_PARAGRAPHS]


def _lines_without_notices(text: str) -> list[str]:
    low = text.lower()
    taken = {n for _, start, end in notices(low) for n in range(low.count("\n", 0, start), low.count("\n", 0, end) + 1)}
    return [line for n, line in enumerate(text.split("\n")) if n not in taken]


def scan_text(text: str, model: Model) -> list[tuple[int, str, float, float]]:
    """(number of its first line, family, probability, template match) of the notices that name a licence."""
    low = text.lower()
    found, number, at = [], 0, 0
    for first, start, end in notices(low):
        number += low.count("\n", at, first)
        at = first
        family, probability, match = model.classify(low[start:end])
        if family != UNKNOWN:
            found.append((number, family, probability, match))
    return found


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per notice that names a licence: doc_id, paragraph (its first line, from 0), family, probability, template_match.

    ``docs`` has doc_id and text; other columns are not read. Null or empty texts give no
    rows, repeated rows give theirs each, an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(sample_paragraphs(docs)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            rows = []
            for doc, text in zip(piece.column("doc_id").to_pylist(), text_array(piece.column("text")).to_pylist()):
                rows += [(doc, *found) for found in scan_text(text, sent.value)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64())
                names = ["doc_id", "paragraph", "family", "probability", "template_match"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(scan, "doc_id bigint, paragraph int, family string, probability double, template_match double")
