"""Quality scores by Bradley-Terry ranking of preference pairs.

From at most `max_rows` labelled rows outside the held-out third, every row of the worse label is paired
with `pairs_each` rows of the better one. The pair's win probability is the logistic function of the
difference of the two scores, a score is linear in a document's features, and gradient descent minimises
the logistic loss over feature differences. The threshold is the quantile of training scores at the share of
the worse label; a document's published score is the logistic function of its distance from that threshold.

Features come from the whole text alone: byte shares, word and line statistics. None uses the label,
language, source or id.

Edge cases: null and empty texts have zero features and are scored like any other; if one label is missing
there are no pairs, all scores are 0.5 and every document is accepted; repeated rows keep a row each; of rows that
repeat a labelled id one is learned from; a score at the threshold is accepted; an empty table gives no rows; a very
long text is one feature vector; other columns keep their names in `keep_accepted` and are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, held_out, id_text, labelled_sample, own

MAX_ROWS = 8000
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r", b".,;:", b"!?", b"|", b"#*$%&<>", b"\"'`", b"()[]{}", b"/\\_=+-~^@", bytes(range(128, 256))]


def features_of(text: bytes) -> np.ndarray:
    """Shares of byte groups in the whole text and in its worst tenth, word and line statistics."""
    n = len(text)
    if not n:
        return np.zeros(3 * len(_GROUPS) + 10, np.float32)
    lookup = np.full(256, len(_GROUPS), np.uint8)
    for i, group in enumerate(_GROUPS):
        lookup[list(group)] = i
    kinds = lookup[np.frombuffer(text, np.uint8)]
    cells = np.arange(n, dtype=np.int64) * 10 // n
    counts = np.bincount(cells * (len(_GROUPS) + 1) + kinds, minlength=10 * (len(_GROUPS) + 1)).reshape(10, -1)[:, : len(_GROUPS)]
    per_cell = counts / np.maximum(np.bincount(cells, minlength=10), 1)[:, None]
    shares = counts.sum(0) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w, distinct, once = max(len(words), 1), len(set(words)), len(set(lines))
    lengths = np.array([len(x) for x in words] or [0])
    return np.concatenate([
        shares, np.sqrt(shares), per_cell.max(0),
        [np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, distinct / w, distinct / np.sqrt(w), 1 - once / max(len(lines), 1),
         lengths.mean() / 10, lengths.std() / 10, min(lengths.max(), 100) / 100, sum(x.isupper() for x in words) / w, sum(x.istitle() for x in words) / w],
    ]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.threshold) / self.spread, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, pairs_each: int = 24, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> Ranker:
    """Bradley-Terry by gradient descent with momentum on the pair loss."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 1e-9, spread, 1.0)
    z = (x - mean) / scale
    dice = np.random.default_rng(7)
    worse = np.repeat(bad, pairs_each)
    better = dice.choice(good, len(worse))
    w, speed = np.zeros(d), np.zeros(d)
    for _ in range(steps):
        s = z @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        g = np.bincount(better, pull, len(y)) - np.bincount(worse, pull, len(y))
        speed = 0.9 * speed + 0.1 * (g @ z / len(worse) - ridge * w)
        w = w + rate * speed
    s = z @ w
    # The quantile at the worse label's share, moved to the middle of the gap between neighbouring scores.
    order = np.sort(s)
    k = len(bad)
    threshold = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    return Ranker(mean, scale, w, threshold, max(float(s.std()) / 4, 1e-6))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ranker:
    """Features are made on the executors; the driver gets max_rows short vectors at most."""

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t).tobytes() for t in as_bytes(texts)], pa.binary())

    rows = sorted((r.doc_id, r.y, bytes(r.x)) for r in labelled_sample(docs, labels, "quality", max_rows).select("doc_id", "y", features("text").alias("x")).collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), len(features_of(b"")))
    return train(x, np.array([r[1] for r in rows], int))


def score(text: Column, model: Ranker) -> Column:
    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        rows = [features_of(t) for t in as_bytes(texts)]
        return pa.array(model.probability(np.array(rows, np.float64).reshape(len(rows), -1)) if rows else [], pa.float64())

    return probability(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_rows)
    return id_text(docs).select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that score at least the threshold, with their columns."""
    model = fit(docs, labels, max_rows)
    tagged = docs.select(F.struct(*[own(c) for c in docs.columns]).alias("row"), score(F.coalesce(F.col("text"), F.lit("")), model).alias("score"))
    return tagged.where(F.col("score") >= threshold).select("row.*")
