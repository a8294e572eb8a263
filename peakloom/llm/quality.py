"""Quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits and runs of other signs, case kept; unigrams and bigrams are hashed into 2**BITS
features whose values are their share of the text's n-grams.  All bigrams of a word with itself are one feature.  Scores are sparse dot products with the broadcast weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordNames, chunks, mixed, texts
from .training import fold, sample

BITS = 18
#: Per-coordinate learning rate, its smoothing, L1 and L2; passes over the sample; the scale of feature shares.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.002, 0.01, 6, 20.0
THRESHOLD = 0.3

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20\x7f0-9A-Za-z\x80-\xff]+")


def features(documents: list[bytes], names: WordNames) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, where each text's begin and the end); a text's bigrams follow its unigrams."""
    words = [_WORD.findall(t) for t in documents]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    name = names.of([x for w in words for x in w])
    counts = np.maximum(2 * sizes - 1, 0)
    bounds, own = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), dtype=np.int64)
    pair = np.where(name[1:] == name[:-1], np.uint64(0x5EED), mixed(name[:-1] * np.uint64(5) + mixed(name[1:])))
    document = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(name)) - own[document]
    shift = np.uint64(64 - BITS)
    out[bounds[document] + place] = (mixed(name) >> shift).astype(np.int64)
    inner = np.flatnonzero(document[1:] == document[:-1])
    out[bounds[document[inner]] + sizes[document[inner]] + place[inner]] = (pair[inner] >> shift).astype(np.int64)
    return out, bounds


class Model:
    """Weights by feature, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[grams], dtype=np.float64)])
        total = (sums[bounds[1:]] - sums[bounds[:-1]]) * SCALE / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """FTRL-proximal; without rows every score is one half."""
    grams, bounds = features([t for t, _ in rows], WordNames(3))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias
    sparse = [np.unique(grams[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            at, count = sparse[k]
            x = np.append(count * (SCALE / max(1, count.sum())), 1.0)
            at = np.append(at, 1 << BITS)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - rows[k][1]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "quality", fold(5) != 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; a null or empty text has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames(3)
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(*features(texts(part), names)))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null doc_id isn't held out."""
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
