"""Quality by compression: texts like the good ones compress better with a dictionary of good texts.

Two zstandard dictionaries are built from good and bad labelled texts. Every text is cut into
blocks, each compressed with either dictionary and with none, so that a long text
leans on the dictionary all along. The difference of the compressed sizes over the raw
size, with the sizes themselves, is calibrated to a probability by logistic regression on
labelled texts that the dictionaries have not seen.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.fitting import fit_logistic, labelled_sample, prior_shift, probability, remainder
from shelfmark.llm.texts import pieces, text_array

BLOCK = 1024
DICTIONARY = 96 << 10
LEVEL = 3
EMPTY_SCORE = 0.0
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """Stretches of as many texts as fit, an even share of each (the raw content of a dictionary)."""
    share = max(64, size // max(1, len(texts)))
    parts = []
    for text in texts:
        middle = max(0, (len(text) - share) // 2)
        parts.append(text[middle : middle + share])
    return b"\n".join(parts)[-size:]


class Sizes:
    """Compressed sizes over raw size: with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def prepared(content: bytes):
            found = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            found.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False)

        self.coders = [prepared(good), prepared(bad), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]

    def features(self, text: bytes) -> list[float]:
        n = max(1, len(text))
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
        each = np.array([[len(c.compress(b)) for c in self.coders] for b in blocks], float)
        good, bad, none = each.sum(axis=0) / n
        leans = (each[:, 1] - each[:, 0]) / np.maximum(64, [len(b) for b in blocks])
        return [bad - good, good, bad, none, (bad - good) / max(none, 1e-3), np.log(n), leans.min(), leans.max()]


N_FEATURES = 8


def fit(texts: list[str], label: np.ndarray, share: float) -> Model:
    """Dictionaries from every other text, calibration on the rest, moved to the true share of good texts."""
    raw = [t.encode() for t in texts]
    fold = np.arange(len(raw)) % 2 == 0
    good = dictionary([t for t, y, f in zip(raw, label, fold) if f and y == 1])
    bad = dictionary([t for t, y, f in zip(raw, label, fold) if f and y == 0])
    sizes = Sizes(good, bad)
    rest = [i for i in range(len(raw)) if not fold[i]]
    x = np.array([sizes.features(raw[i]) for i in rest]).reshape(len(rest), N_FEATURES)
    mean = x.mean(axis=0) if len(rest) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(rest) else np.ones(N_FEATURES)
    weights = fit_logistic(_terms((x - mean) / scale), label[rest], ridge=0.1) if len(rest) else np.zeros(2 * N_FEATURES + 1)
    weights[-1] += prior_shift(label, share)
    return Model(good, bad, mean, scale, weights)


def _terms(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([z, z * z])


class Scorer:
    """A model with its compressors, made once per task."""

    def __init__(self, model: Model):
        self.model, self.sizes = model, Sizes(model.good, model.bad)

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw = [t.as_buffer().to_pybytes() for t in text_array(texts)]
        x = np.array([self.sizes.features(t) for t in raw]).reshape(len(raw), N_FEATURES)
        found = probability(_terms((x - self.model.mean) / self.model.scale), self.model.weights)
        return np.where(np.array([bool(t) for t in raw], bool), found, EMPTY_SCORE)


def learned_model(docs: DataFrame, labels: DataFrame, divisor: int, held_out: int) -> Model:
    return fit(*labelled_sample(docs, labels.filter(remainder("doc_id", divisor) != held_out), "quality"))


def score_quality(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from THRESHOLD on).

    Rows whose crc32 of the id has the remainder ``held_out`` are never learned from; ids
    that are null are not held out and have no label. ``docs`` has doc_id and text, ``labels``
    doc_id and quality; no other column is read. Null text counts as empty. Repeated rows are scored alike.
    An empty table gives no rows; without usable labels every text scores 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned_model(docs, labels, divisor, held_out))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for piece in pieces(batches, "text"):
            ids = piece.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(scorer.scores(piece.column("text")))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(build, "doc_id bigint, score double")
    out = F.coalesce(remainder("doc_id", divisor) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """The documents not rejected, with their own columns; they are judged where they lie, none is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(learned_model(docs, labels, divisor, held_out))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for piece in pieces(batches, "text"):
            yield piece.filter(pa.array(scorer.scores(piece.column("text")) >= THRESHOLD))

    return docs.mapInArrow(build, docs.schema)
