"""Bounded samples of labelled texts, and logistic regression on them."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The models are fitted on at most this many labelled texts of each class, the first by a hash
# of their id, and of these on texts of at most FIT_CHARS characters. Scoring has no such bounds.
FIT_TEXTS = 4_000
FIT_CHARS = 20_000


def remainder(doc_id: str, divisor: int):
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_TEXTS, chars: int = FIT_CHARS) -> tuple[list[str], np.ndarray, float]:
    """Texts and 0/1 labels of a bounded sample in a fixed order, and the share of label 1 among all labels.

    ``labels`` has doc_id and the label; rows with a null in either are left out, and of
    several labels of one document the largest counts. At most ``2 * most`` ids are named to the scan.
    """
    named = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = named.agg(F.avg("label")).first()[0]
    picked = None
    for value in (0, 1):
        part = named.filter(F.col("label") == value).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.filter(F.length("text").between(1, chars)).select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], float), 0.5 if share is None else float(share)


def prior_shift(label: np.ndarray, share: float) -> float:
    """What the intercept lacks because the classes were not sampled in their true share."""
    odds = (label.sum() + 0.5) / (len(label) - label.sum() + 0.5)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)) - np.log(odds)) if len(label) else 0.0


def fit_logistic(features: np.ndarray, label: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights with the intercept last, by Newton's method with a ridge on all but the intercept."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - label) + penalty * weights
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
