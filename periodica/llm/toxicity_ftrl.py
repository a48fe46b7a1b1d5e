"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words (0-9, a-z after lower-casing, all bytes above ASCII) give unigrams, whole and cut to a stem of four
bytes, bigrams and pairs that skip one word, hashed to `2**bits` coordinates and counted once per text. Training takes at most `max_rows` labelled
rows outside the held-out third (the smallest id hashes), in a fixed order, `passes` times; each coordinate
has its own learning rate and L1 leaves most weights exactly zero. The weights that stay (bounded by the
coordinates, in practice a few thousand) are broadcast as two short arrays, and every whole text is scored.

Edge cases: null and empty texts score by the intercept alone; an empty table gives no rows; a very long text has no
more than its distinct coordinates; scores that tie are alike; of repeated labelled rows one is learned from; other columns are not read; without labelled rows all weights are zero
and the intercept is -4, so nothing is flagged; repeated rows keep a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, held_out, id_text, labelled_sample
from periodica.llm.wu_manber import words_of

BITS = 20
MAX_ROWS = 6000
MAX_WORDS = 200_000
#: Leading bytes of a word that stand for its inflected forms.
STEM = 4


@dataclass(frozen=True)
class Ftrl:
    """Settings; the defaults have the smallest `fold_loss` of those compared on training rows alone (README)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    passes: int = 6


class Hasher:
    """Coordinates of a text; word hashes are remembered up to a bound."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > MAX_WORDS:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = (digest(w), digest(w[:STEM], 1))
            hashes.append(h)
        h, stems = np.array(hashes, np.uint64).reshape(-1, 2).T
        mix, odd, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        pairs = (h[:-1] * odd + h[1:]) * mix
        skips = (h[:-2] * skip + h[2:] * odd) * mix
        return (np.concatenate([h * mix, stems * mix, pairs, skips]) >> self.shift).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, how: Ftrl = Ftrl()) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coordinates, weights) from (distinct coordinates, label) rows in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    if not rows:
        return -4.0, np.zeros(0, np.int32), np.zeros(0, np.float32)

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.where(at == bias, 0.0, how.l1)
        return np.where(np.abs(z[at]) <= free, 0.0, (np.sign(z[at]) * free - z[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.passes):
        for coordinates, label in rows:
            at = np.append(coordinates, bias)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            z[at] += slope - (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / how.alpha * w
            n[at] += slope * slope
    every = weights(np.arange(bias + 1))
    at = np.flatnonzero(every[:-1]).astype(np.int32)
    return float(every[-1]), at, every[at].astype(np.float32)


def fold_loss(rows: list[tuple[np.ndarray, int]], how: Ftrl, folds: int = 3, bits: int = BITS) -> float:
    """Mean log loss of training rows under models that haven't seen them: how settings are chosen without held-out labels."""
    losses = []
    for f in range(folds):
        intercept, at, kept = train([r for i, r in enumerate(rows) if i % folds != f], bits, how)
        dense = np.zeros(1 << bits)
        dense[at] = kept
        for x, y in rows[f::folds]:
            p = 1 / (1 + np.exp(-np.clip(intercept + dense[x].sum(), -30, 30)))
            losses.append(-np.log(np.clip(p if y else 1 - p, 1e-6, 1)))
    return float(np.mean(losses))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, how: Ftrl = Ftrl()) -> tuple[float, np.ndarray, np.ndarray]:
    """Texts are hashed on the executors; the driver receives distinct coordinates of max_rows rows at most."""

    @F.arrow_udf("binary")
    def coordinates(texts: pa.Array) -> pa.Array:
        hashed = Hasher(bits)
        return pa.array([np.unique(hashed(t)).astype(np.int32).tobytes() for t in as_bytes(texts)], pa.binary())

    sample = labelled_sample(docs, labels, "toxic", max_rows).select("doc_id", "y", coordinates("text").alias("x"))
    rows = [(r.doc_id, r.y, np.frombuffer(r.x, np.int32)) for r in sample.toLocalIterator()]
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), len(r[2])))
    return train([(x, y) for _, y, x in rows], bits, how)


def score(text: Column, model: tuple[float, np.ndarray, np.ndarray], bits: int = BITS) -> Column:
    """Probability of toxicity. The closure carries the non-zero weights."""
    intercept, at, kept = model

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        dense, hashed = np.zeros(1 << bits, np.float32), Hasher(bits)
        dense[at] = kept
        live = dense != 0
        sums = []
        for t in as_bytes(texts):
            x = hashed(t)
            sums.append(intercept + float(dense[np.unique(x[live[x]])].sum(dtype=np.float64)))
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -30, 30))), pa.float64())

    return probability(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_rows)
    return id_text(docs).select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
