"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give scores and offending offsets.

Only documents are labelled, so tokens get their labels from them: a word is marked toxic where it or one of its prefixes
is far more frequent in toxic documents than in others (copies of a document count once).  The field has two states;
a token's features are a constant, its word, prefixes and suffix, hashed, and its transitions are learned.  As features depend on the
word alone, a word's emission is computed once and kept.  A document's score is a logistic function of how many toxic
tokens the forward-backward marginals expect.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes, texts
from .decontaminate import _FOLD, words
from .training import fold, sample

BITS = 18
#: Prefixes in bytes; how many differing toxic documents a marker needs, and how much likelier it is in toxic ones.
PREFIXES, SUPPORT, ODDS = range(4, 9), 4, 25.0
#: Documents whose so many least-hashed words agree are copies of one another.
COPY_WORDS = 8
#: Steps, learning rate and ridge of the fit.
STEPS, RATE, RIDGE = 60, 0.3, 1e-6
THRESHOLD = 0.7
#: A token is reported as toxic from this marginal on.
TAGGED = 0.5


def token_features(word: bytes) -> list[int]:
    shift, digest = 64 - BITS, xxhash.xxh64_intdigest
    own = [digest(word[:k], 9) >> shift for k in PREFIXES if k <= len(word)]
    return [*own, digest(word, 10) >> shift, digest(word[-3:], 11) >> shift, 0]


class Chains:
    """Forward and backward odds over token sequences of any length, many at once.

    Sequences are cut into blocks of ``BLOCK`` tokens, laid out step by step.  A first sweep multiplies each block's 2 x 2
    transfer matrix, a scan over a sequence's blocks gives what enters and leaves each, and a second sweep fills the
    blocks in; so the number of array steps is about ``BLOCK`` plus the blocks of the longest sequence."""

    BLOCK = 128

    def __init__(self, lengths: np.ndarray):
        count = -(-lengths // self.BLOCK)
        first = np.cumsum(count) - count
        inner = np.arange(int(count.sum())) - np.repeat(first, count)
        size = np.minimum(self.BLOCK, np.repeat(lengths, count) - inner * self.BLOCK)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), dtype=np.int64)
        rank[order] = np.arange(len(size))
        self.active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # longer than t
        offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.place = offset[step] + np.repeat(rank, size)
        self.slices = [slice(a, b) for a, b in zip(offset[:-1], offset[1:])]
        self.opens = (inner == 0)[order]
        #: For each k, the k-th blocks of the sequences that have so many.
        some = np.argsort(-count, kind="stable")
        running = np.searchsorted(-count[some], -np.arange(int(count.max(initial=0))), side="left")
        self.scan = [rank[first[some[:n]] + k] for k, n in enumerate(running)]
        self.last = offset[size[order] - 1] + np.arange(len(size)) if len(size) else size

    def marginals(self, odds: np.ndarray, start: float, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's forward and backward odds of state 1.

        ``odds``: emission odds of state 1; ``start``: its prior odds; ``a``: transition weights [from, to]."""
        e = np.empty(len(odds))
        e[self.place] = odds
        c00, c01 = np.where(self.opens, 1.0, a[0, 0]), np.where(self.opens, start, a[0, 1])
        c10, c11 = np.where(self.opens, 1.0, a[1, 0]), np.where(self.opens, start, a[1, 1])
        through = np.empty((4, len(self.opens)))
        for t, now in enumerate(self.slices):
            if t == 0:
                p = np.array([c00, c01 * e[now], c10, c11 * e[now]])
            else:
                q = through[:, : self.active[t]]
                p = np.array([q[0] * a[0, 0] + q[1] * a[1, 0], (q[0] * a[0, 1] + q[1] * a[1, 1]) * e[now], q[2] * a[0, 0] + q[3] * a[1, 0], (q[2] * a[0, 1] + q[3] * a[1, 1]) * e[now]])
            through[:, : self.active[t]] = p / p.sum(axis=0)
        enters, leaves = np.ones(len(self.opens)), np.ones(len(self.opens))  # odds in both directions
        for k in range(1, len(self.scan)):
            own = self.scan[k]
            last = self.scan[k - 1][: len(own)]
            p = through[:, last]
            enters[own] = (p[1] + enters[last] * p[3]) / (p[0] + enters[last] * p[2])
        for k in reversed(range(1, len(self.scan))):
            own = self.scan[k]
            p = through[:, own]
            leaves[self.scan[k - 1][: len(own)]] = (p[2] + p[3] * leaves[own]) / (p[0] + p[1] * leaves[own])
        forward, backward = np.empty(len(e)), np.empty(len(e))
        for t, now in enumerate(self.slices):
            if t == 0:
                forward[now] = e[now] * (c01 + c11 * enters) / (c00 + c10 * enters)
            else:
                f = forward[self.slices[t - 1]][: self.active[t]]
                forward[now] = e[now] * (a[0, 1] + a[1, 1] * f) / (a[0, 0] + a[1, 0] * f)
        backward[self.last] = leaves
        for t in reversed(range(len(self.slices) - 1)):
            eg = e[self.slices[t + 1]] * backward[self.slices[t + 1]]
            backward[self.slices[t]][: self.active[t + 1]] = (a[1, 0] + a[1, 1] * eg) / (a[0, 0] + a[0, 1] * eg)
        return forward[self.place], backward[self.place]


class Model:
    def __init__(self, weights: np.ndarray, start: float, moves: np.ndarray, slope: float, bias: float):
        self.weights, self.start, self.moves, self.slope, self.bias = weights, start, moves, slope, bias

    def tokens(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each token's marginal."""
        if not len(odds):
            return np.zeros(0)
        forward, backward = Chains(lengths).marginals(odds, self.start, self.moves)
        return 1 - 1 / (1 + forward * backward)

    def documents(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(expected(marginals, lengths)) + self.bias, -35, 35)))


def expected(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Toxic tokens to expect in each document."""
    sums, bounds = np.concatenate([[0.0], np.cumsum(marginals)]), np.concatenate([[0], np.cumsum(lengths)])
    return np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], 0)


class Emissions(dict):
    """Emission odds of each word, kept while fewer than ``limit`` words are held."""

    def __init__(self, model: Model, limit: int = 150_000):
        super().__init__()
        self.weights, self.limit = model.weights.tolist(), limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        weights = self.weights
        value = self[word] = math.exp(min(30.0, max(-30.0, sum([weights[f] for f in token_features(word)]))))
        return value


def markers(documents: list[list[bytes]], toxic: list[int]) -> set[bytes]:
    """Words (after b"w") and prefixes (after b"p") that mark toxic documents.

    Only what is in toxic documents is counted in the others, which bounds the counts by the smaller class."""

    def parts(own: list[bytes]) -> tuple[int, set[bytes]]:
        distinct = set(own)
        least = heapq.nsmallest(COPY_WORDS, (xxhash.xxh64_intdigest(w, 17) for w in distinct))  # mostly alike in near copies
        return hash(tuple(least)), {b"w" + w for w in distinct} | {b"p" + w[:k] for w in distinct for k in PREFIXES if k <= len(w)}

    totals: tuple[set[int], set[int]] = (set(), set())
    seen: dict[bytes, set[int]] = defaultdict(set)
    for own, y in zip(documents, toxic):
        if y and own:
            copy, found = parts(own)
            totals[1].add(copy)
            for x in found:
                seen[x].add(copy)
    seen = {x: c for x, c in seen.items() if len(c) >= SUPPORT}
    others: dict[bytes, set[int]] = {x: set() for x in seen}
    for own, y in zip(documents, toxic):
        if not y and own:
            copy, found = parts(own)
            totals[0].add(copy)
            for x in found & others.keys():
                others[x].add(copy)
    rate = (len(totals[1]) + 1) / (len(totals[0]) + 1)
    return {x for x, c in seen.items() if len(c) + 0.5 >= ODDS * rate * (len(others[x]) + 0.5)}


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Without rows, or without any of one label, every score is that label's share (one half without rows)."""
    documents, toxic = [words(t) for t, _ in rows], [y for _, y in rows]
    y = np.array(toxic, dtype=float)
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    if not 0 < share < 1 or not lengths.sum():
        return Model(np.zeros(1 << BITS), 1e-3, np.ones((2, 2)), 0.0, prior)
    marked = markers(documents, toxic)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in documents for w in d), dtype=np.int32)
    hits = np.array([b"w" + w in marked or any(b"p" + w[:k] in marked for k in PREFIXES if k <= len(w)) for w in number])
    label = (hits[ids] & np.repeat(y > 0, lengths)).astype(float)
    n_words, counts = len(number), np.zeros(len(number), dtype=np.int64)

    def each():
        for k, w in enumerate(number):
            found = token_features(w)
            counts[k] = len(found)
            yield from found

    feature = np.fromiter(each(), dtype=np.int32)
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), counts)
    del documents, number, hits, marked

    chains = Chains(lengths)
    opening = np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]
    follows = np.ones(len(ids), dtype=bool)
    follows[opening] = False
    nxt = np.flatnonzero(follows)
    seen = np.bincount((2 * label[nxt - 1] + label[nxt]).astype(np.int64), minlength=4).reshape(2, 2)
    fields = [np.zeros(1 << BITS), np.zeros((2, 2)), np.zeros(1)]  # weights, transitions, start: all as logarithms
    slopes, squares = [np.zeros_like(x) for x in fields], [np.full_like(x, 1e-12) for x in fields]
    for turn in range(STEPS):
        a = np.exp(fields[1])
        emission = np.bincount(of_word, fields[0][feature], minlength=n_words)
        e = np.exp(np.clip(emission, -30, 30))[ids]
        forward, backward = chains.marginals(e, float(np.exp(fields[2][0])), a)
        p = 1 - 1 / (1 + forward * backward)
        eg, f = (e * backward)[nxt], forward[nxt - 1]
        pair = np.array([np.full(len(nxt), a[0, 0]), a[0, 1] * eg, a[1, 0] * f, a[1, 1] * f * eg])
        pair = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
        per_word = np.bincount(ids, label - p, minlength=n_words)
        found = [np.bincount(feature, per_word[of_word], minlength=1 << BITS), seen - pair, np.array([(label[opening] - p[opening]).sum()])]
        for x, g, m, v in zip(fields, found, slopes, squares):  # Adam: the early, large gradients are forgotten
            g = g / len(rows) - RIDGE * x
            m += 0.2 * (g - m)
            v += 0.1 * (g * g - v)
            x += RATE / (1 + turn / 30) * m / np.sqrt(v + 1e-16)
    weights, moves, start = fields
    model = Model(weights, float(np.exp(start[0])), np.exp(moves), 0.0, 0.0)
    emission = np.bincount(of_word, weights[feature], minlength=n_words)
    x = np.log1p(expected(model.tokens(np.exp(np.clip(emission, -30, 30))[ids], lengths), lengths))
    slope, bias = 1.0, prior
    for _ in range(60):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(slope * x + bias, -35, 35)))
        g = np.array([((y - q) * x).sum() - 1e-2 * slope, (y - q).sum() - 1e-2 * bias])
        v = q * (1 - q)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        slope, bias = np.array([slope, bias]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return Model(weights, model.start, model.moves, float(slope), float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "toxic", fold(3) != 1))


def token_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets [start, end) of a text's words."""
    folded = np.frombuffer(text.translate(_FOLD), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], folded.astype(np.int8), [0]])))
    return list(map(tuple, edges.reshape(-1, 2).tolist()))


def score(docs: DataFrame, model: Model, offsets: bool = True) -> DataFrame:
    """(doc_id, score, offsets array<struct<start,end>>) for every row: the byte offsets of tokens tagged toxic.

    A null or empty text has no tokens and the score of expecting none.  Whole texts are tagged, whatever their length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        kept = Emissions(own)
        for part in chunks(batches, "text"):
            raw = texts(part)
            tokens = [words(t) for t in raw]
            lengths = np.array([len(d) for d in tokens], dtype=np.int64)
            odds = np.fromiter((kept[w] for d in tokens for w in d), dtype=float, count=int(lengths.sum()))
            m = own.tokens(odds, lengths)
            spans: list = [[] for _ in raw]
            if offsets:
                tagged, ends = np.flatnonzero(m >= TAGGED), np.cumsum(lengths)
                for k in np.unique(np.searchsorted(ends, tagged, side="right")).tolist():
                    where, own_tokens = token_spans(raw[k]), tagged[(tagged >= ends[k] - lengths[k]) & (tagged < ends[k])] - (ends[k] - lengths[k])
                    spans[k] = [{"start": where[t][0], "end": where[t][1]} for t in own_tokens.tolist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.documents(m, lengths)), pa.array(spans, kind)], ["doc_id", "score", "offsets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offsets array<struct<start:long,end:long>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offsets) for every row; a null doc_id isn't held out."""
    rows = score(docs, train(docs, labels))
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offsets")


def without_toxic(docs: DataFrame, learn: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they are.

    The model is fitted on ``learn``, the documents that ``labels`` speaks of.  Rows are scored where they are read: their
    other columns travel along, so nothing is joined and rows that repeat an id are judged one by one."""
    model = train(learn, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        kept = Emissions(own)
        for part in chunks(batches, "text"):
            tokens = [words(x.encode(errors="surrogatepass") if x else b"") for x in part.column(place).to_pylist()]
            lengths = np.array([len(d) for d in tokens], dtype=np.int64)
            m = own.tokens(np.fromiter((kept[w] for d in tokens for w in d), dtype=float, count=int(lengths.sum())), lengths)
            yield part.filter(pa.array(own.documents(m, lengths) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
