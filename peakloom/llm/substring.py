"""Long repeated passages found by recompression.

Rounds rename the words of all documents alike: a round first names maximal runs of one symbol, then names the pairs whose
left symbol has coin 1 and whose right symbol has coin 0.  Names and coins are hashes of what they stand for, so Spark's
tasks agree on all names without exchanging them.  Each symbol carries the words that decided it, [low, high): equal words
there give the equal symbol in any document.  For a window of 50 words the symbols decided inside it are thus the same
wherever it occurs, and the highest-level one, that of the most words (then of the least name), is the window's key: long
phrases are rare unless they are repeats.  A window without any symbol (one inside a long run, say) has a key of its own
words.

Consecutive windows with one key are a segment, about one for every 18 words, and only segments are exchanged; those of a
document that have the same words are one row with all their places, so a text that repeats a few words over and over has a
few rows and not one for each window.  A key that one document has is no repeat.  Where all segments of a key have the same words (a 64-bit polynomial hash of them, beside
the key), those of all but the smallest document go at once.  A key whose segments differ lies at the edge of a repeat: of
each variant the smallest document's segment stands for the others, and its windows are verified one by one, again by a
hash of their 50 words beside the key.  All groups are sums with map-side combining.  Keys are joined back
by broadcast where they are hot (a bounded number of keys can be) and by shuffle elsewhere; joins of variants and windows
are split by adaptive execution where one is hot.  No group of copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordNames, chunks, mixed, split_join, stored, text_bytes, texts

WINDOW, ROUNDS = 50, 3
_LAST = (1 << 63) - 1  # a null doc_id comes after all others
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: spans: the first and last window's start of each place, as low << 32 | high.
_SEGMENTS = "array<struct<key:long,hash:long,spans:array<long>>>"


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def name_runs(name: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A maximal run of k > 1 equal symbols becomes one; what ends a run on either side also decides it."""
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    last = np.concatenate([first[1:], [len(name)]]) - 1
    out, length = name[first], (last - first + 1).astype(np.uint64)
    many = length > 1
    out[many] = mixed(out[many] ^ mixed(length[many] + _u(0xA5A5)))
    return out, low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(name) - 1)], np.add.reduceat(size, first)


def name_pairs(name: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (coin 1, coin 0) become one symbol; a symbol left alone was also decided by the neighbour it didn't join."""
    coin = (mixed(name + _u(turn * 0x51ED27)) >> _u(63)).astype(bool)
    joins = coin[:-1] & ~coin[1:]
    left, right = np.concatenate([joins, [False]]), np.concatenate([[False], joins])
    after, before = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
    out = np.where(left, mixed(name * _u(3) + mixed(name[after] + _u(0x7F4A))), name)
    high = np.where(left | coin, high[after], high)
    low = np.where(left | coin, low, low[before])
    return out[~right], low[~right], high[~right], np.where(left, size + size[after], size)[~right]


class Parsed:
    """Documents put end to end, a unique separator before, between and after them."""

    def __init__(self, documents: list[list[bytes]], names: WordNames):
        self.sizes = np.array([len(d) for d in documents], dtype=np.int64)
        self.starts = np.cumsum(np.concatenate([[1], self.sizes[:-1] + 1])) if len(documents) else np.zeros(0, np.int64)
        n = int(self.sizes.sum()) + len(documents) + 1
        self.name = mixed(np.arange(n, dtype=np.uint64) + _u(1 << 40))
        for d, s in zip(documents, self.starts):
            if d:
                self.name[s : s + len(d)] = names.of(d)
        counts = np.maximum(self.sizes - WINDOW + 1, 0)
        self._sums = None
        #: Where each window starts, and its document.
        self.owner = np.repeat(np.arange(len(documents)), counts)
        ends = np.cumsum(counts)
        self.window = np.repeat(self.starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(counts) else 0)

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words of each range [first, end)."""
        n = len(self.name)
        if self._sums is None:
            self._power = np.cumprod(np.concatenate([[_u(1)], np.full(n, _u(_BASE))]), dtype=np.uint64)
            self._back = np.cumprod(np.concatenate([[_u(1)], np.full(n, _u(_INVERSE))]), dtype=np.uint64)
            self._sums = np.concatenate([[_u(0)], np.cumsum(self.name * self._power[:n], dtype=np.uint64)])
        return mixed((self._sums[end] - self._sums[first]) * self._back[first] + (end - first).astype(np.uint64))

    def keys(self) -> np.ndarray:
        """The key of each window."""
        place = np.arange(len(self.name), dtype=np.int64)
        name, low, high, size = self.name, place, place + 1, np.ones_like(place)
        for turn in range(ROUNDS):
            name, low, high, size = name_pairs(*name_runs(name, low, high, size), turn)
        rank = (_u(15) - np.minimum(size, 15).astype(np.uint64) << _u(60)) | (mixed(name + _u(0x2545F491)) >> _u(4))
        begin, end = np.searchsorted(low, self.window, "left"), np.searchsorted(high, self.window + WINDOW, "right")
        inside, key, level, least = end - begin, np.zeros(len(self.window), dtype=np.uint64), 0, rank
        while (some := inside >= (1 << level)).any():
            own = some & (inside < (2 << level))
            key[own] = np.minimum(least[begin[own]], least[end[own] - (1 << level)])
            least = np.minimum(least, np.concatenate([least[1 << level :], least[len(least) - (1 << level) :]])[: len(least)])
            level += 1
        bare = inside <= 0
        if bare.any():
            key[bare] = mixed(self.hashes(self.window[bare], self.window[bare] + WINDOW) + _u(0x1B873593))
        return key


def _grouped(owner: np.ndarray, n: int, key: np.ndarray, same: np.ndarray, span: np.ndarray) -> pa.ListArray:
    """For each of n documents its (key, hash), each with its spans in any order.

    Rows are sorted by one number; where two different pairs agree in its 40 bits, one of them may come more than once."""
    order = np.argsort(owner.astype(np.uint64) << _u(40) | mixed(key.view(np.uint64) ^ mixed(same.view(np.uint64))) >> _u(24))
    owner, key, same, span = owner[order], key[order], same[order], span[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (same[1:] != same[:-1])
    first = np.flatnonzero(new)
    spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(span, pa.int64()))
    offsets = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(key[first]), pa.array(same[first]), spans], names=["key", "hash", "spans"]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = WordNames(1)
    for part in chunks(batches, "text"):
        parsed = Parsed([t.split() for t in texts(part)], names)
        key = parsed.keys()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (parsed.owner[1:] != parsed.owner[:-1])])) if len(key) else np.zeros(0, np.int64)
        last = np.concatenate([edge[1:], [len(key)]]).astype(np.int64) - 1 if len(edge) else edge
        owner = parsed.owner[edge]
        shift = parsed.starts[owner]
        same = parsed.hashes(parsed.window[edge], parsed.window[last] + WINDOW).view(np.int64)
        segments = _grouped(owner, part.num_rows, key[edge].view(np.int64), same, (parsed.window[edge] - shift) << 32 | (parsed.window[last] - shift))
        yield pa.RecordBatch.from_arrays([*part.columns[:2], segments], ["id", "print", "segments"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = WordNames(1)
    for part in chunks(batches, "text"):
        parsed = Parsed([t.split() for t in texts(part)], names)
        segments = part.column(part.schema.get_field_index("segments"))
        each = segments.flatten()
        places = each.field("spans")
        n_places = pc.list_value_length(places).to_numpy()
        span = places.flatten().to_numpy()
        low, count = span >> 32, (span & 0xFFFFFFFF) - (span >> 32) + 1
        owner = np.repeat(np.repeat(np.repeat(np.arange(part.num_rows), pc.list_value_length(segments).to_numpy()), n_places), count)
        key = np.repeat(np.repeat(each.field("key").to_numpy(), n_places), count)
        start = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        first = start + parsed.starts[owner]
        windows = _grouped(owner, part.num_rows, key, parsed.hashes(first, first + WINDOW).view(np.int64), start << 32 | start)
        yield pa.RecordBatch.from_arrays([*part.columns[:2], windows], ["id", "print", "windows"])


def kept_words(words: list[bytes], ranges: list[int] | None) -> list[bytes]:
    """Without the words of the windows that start in the ranges [low, high], each given as low << 32 | high."""
    if not ranges:
        return words
    edge, spans = np.zeros(len(words) + 1, dtype=np.int64), np.array(ranges, dtype=np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, (spans & 0xFFFFFFFF) + WINDOW, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def repeats(docs: DataFrame) -> DataFrame:
    """(id, print, ranges array<long>): where removed windows start, as low << 32 | high, in the texts that have any.

    ``docs`` has id, print (a hash of the text) and text (bytes), and maybe more columns, which are kept in the text's
    shuffle so that a later join by id and print can use it again."""
    parsed = stored(docs.select("id", "print", "text").mapInArrow(_parse, f"id long, print long, segments {_SEGMENTS}"))
    rows = parsed.select("id", "print", F.explode("segments").alias("s")).select("id", "print", "s.*")
    n = F.count(F.lit(1)).alias("n")
    shared = stored(rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), n).where("a < z").select("key", "n"))
    total = shared.agg(F.sum("n")).head()[0] or 0
    hits = stored(split_join(rows, shared, ["key"], total))
    variants = stored(hits.groupBy("key", "hash").agg(F.min("id").alias("least"), n))
    edges = stored(variants.groupBy("key").agg(n).where("n > 1"))
    sided = hits.join(variants.drop("n"), ["key", "hash"])  # of stored tables: adaptive execution splits a hot variant
    stand = split_join(sided.where("id = least"), edges, ["key"], total).groupBy("id", "print").agg(F.collect_list(F.struct("key", "spans")).alias("segments"))
    windows = docs.join(stand, ["id", "print"]).select(*docs.columns, "segments").mapInArrow(_verify, f"id long, print long, windows {_SEGMENTS}")
    each = windows.select("id", "print", F.explode("windows").alias("w")).select("id", "print", "w.*")
    # a group-by right below a join would tie the join's partitions to its own and keep a hot window whole: so the join's
    # key is another column than the group's, and adaptive execution can split it
    apart = F.col("hash").bitwiseXOR(F.lit(1))
    least = each.groupBy("key", "hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", apart.alias("apart"), "least")
    single = each.withColumn("apart", apart).join(least, ["key", "apart"]).where("id > least").select("id", "print", "spans")
    whole = sided.where("id > least").select("id", "print", "spans")
    return whole.unionByName(single).groupBy("id", "print").agg(F.flatten(F.collect_list("spans")).alias("ranges"))


def _prepared(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("print"), text_bytes().alias("text"), *more)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's numbers of words and of removed ones, and its kept words."""
    for part in chunks(batches, "text"):
        counts, removed, out = [], [], []
        for t, ranges in zip(texts(part), part.column(part.schema.get_field_index("ranges")).to_pylist()):
            words = t.split()
            kept = kept_words(words, ranges)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            out.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary())], [*part.schema.names[:-1], "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary, text binary, ...) for every row: its words but those that a removed window
    covers, and the columns ``more`` of ``docs``.

    A window of 50 consecutive words is removed if its words also start in a document with a smaller doc_id.  Null texts
    have no words.  A null doc_id comes after all others; rows that share an id aren't smaller than each other, so a row
    repeated as it is keeps its words.  Texts of fewer than 50 words keep all; a long text is parsed whole, in one chunk.
    Other columns of ``docs`` are not read, whatever their names.  An empty table gives an empty result."""
    rows = _prepared(docs, *more)
    joined = rows.join(repeats(rows), ["id", "print"], "left").select(*rows.columns, "ranges")
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    done = joined.mapInArrow(_cut, f"{kinds}, n_words long, n_removed long, kept binary")
    return done.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept", "text", *more)


def cut(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) without their repeated passages; every row stays.

    A text that loses nothing stays as it is, spaces included; of the others the kept words are joined by one space, and
    n_chars follows.  See ``without_repeats`` for what is removed and for nulls."""
    kinds = dict(docs.dtypes)
    done = without_repeats(docs.withColumn("missing", F.col("text").isNull()), "lang", "source", "n_chars", "missing")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).when(~F.col("missing"), F.col("text").cast("string"))
    n = F.when(changed, F.char_length(F.col("kept").cast("string")).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return done.select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), text.alias("text"), "lang", "source", n.alias("n_chars"))


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i)
), least AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY g
), covered AS (
  SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(generate_series(i, i + 49)) AS p FROM grams JOIN least USING (g) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)) GROUP BY r
), words AS (
  SELECT d.r, p, w[p] AS x FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS p)
), gone AS (SELECT r, unnest(gone) AS p, true AS yes FROM covered
), kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM words LEFT JOIN gone USING (r, p) WHERE yes IS NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
