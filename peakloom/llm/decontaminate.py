"""Benchmark decontamination with one FM-index for each training shard.

A shard is a few megabytes of whole documents.  Its words become symbols (words that no benchmark item has fold into one
separator, and runs between separators that are shorter than every window are left out, as no window fits there); the
shard's suffix array gives the Burrows-Wheeler transform, held as a wavelet matrix.  All windows are searched backward at
once through the matrix's ranks, and each occurrence is located by walking to a sampled suffix position.  Occurrences
merge into spans of hit words.  Shards are cut from a task's own rows, so nothing is shuffled.

The benchmark is a query set.  Up to ``BLOCK_BYTES`` of it are broadcast as they are, and each worker numbers their windows
once.  A larger benchmark is cut into blocks of that size; each block is a pass of its own that writes the rows it hits to
the shared folder, and the passes' spans meet by row, so neither a worker, the driver nor a broadcast ever holds more than
a block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shared_folder, text_bytes, texts

WINDOW = 8
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
#: Every so many text positions have their suffix position kept.
SAMPLE = 8

_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_STATE = "array<struct<start:long,end:long>>"


def words(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and anything from U+0080."""
    return text.translate(_FOLD).split()


class Wavelet:
    """A wavelet matrix over symbols: ranks and accesses for many positions at once."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.bits, self.zeros, self.count = len(symbols), [], [], []
        current = symbols
        for level in reversed(range(max(1, int(symbols.max(initial=0)).bit_length()))):
            bit = (current >> level) & 1
            self.count.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            self.bits.append((level, bit.astype(np.int8)))
            self.zeros.append(int(self.count[-1][-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``position``."""
        start, end = np.zeros_like(position), position
        for (level, _), zeros, count in zip(self.bits, self.zeros, self.count):
            one = ((symbol >> level) & 1) == 1
            start = np.where(one, zeros + start - count[start], count[start])
            end = np.where(one, zeros + end - count[end], count[end])
        return end - start

    def access(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for (level, bit), zeros, count in zip(self.bits, self.zeros, self.count):
            one = bit[position] == 1
            symbol |= one.astype(np.int64) << level
            position = np.where(one, zeros + position - count[position], count[position])
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n, step = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    while True:
        tail = np.zeros(n, dtype=np.int64)
        tail[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Full-text index of symbols >= 1."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate([symbols.astype(np.int64), [0]])  # the end sorts first
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.wavelet = Wavelet(last)
        self.kept = order % SAMPLE == 0
        self.samples = order[self.kept]
        self.nth = np.cumsum(self.kept) - 1

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence; one pattern of equal length in each row."""
        alive = np.flatnonzero((patterns < len(self.first) - 1).all(axis=1))
        low, high = np.zeros(len(alive), dtype=np.int64), np.full(len(alive), self.wavelet.n, dtype=np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k].astype(np.int64)
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        times = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]) if len(low) else low, times) + np.arange(times.sum())
        return np.repeat(alive, times), self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        place, todo, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(todo):
            done = self.kept[rows]
            place[todo[done]] = self.samples[self.nth[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.wavelet.access(rows)
            rows = self.first[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return place


class Windows:
    """The distinct windows of a block of items, by length, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        tokens = [words(text) for _, text in items]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        fresh = self.vocabulary
        ids = np.fromiter((fresh.setdefault(w, len(fresh) + 2) for t in tokens for w in t), dtype=np.int32, count=int(sizes.sum()))
        owner, start = np.array([number[name] for name, _ in items], dtype=np.int64), np.cumsum(sizes) - sizes
        self.by_length = []
        for length in sorted(set(np.minimum(sizes[sizes > 0], WINDOW).tolist())):
            own = np.flatnonzero((sizes == length) if length < WINDOW else (sizes >= WINDOW))
            count = sizes[own] - length + 1
            at = np.repeat(start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            patterns, which = np.unique(np.lib.stride_tricks.sliding_window_view(ids, length)[at], axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * len(self.items) + np.repeat(owner[own], count))
            bounds = np.searchsorted(pairs, np.arange(len(patterns) + 1) * len(self.items))
            self.by_length.append((patterns, bounds, pairs % len(self.items)))
        self.shortest = min((p.shape[1] for p, _, _ in self.by_length), default=0)


def search_shard(documents: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of occurrences over the shard's words put end to end, and sorted unique document * items + item."""
    none = np.zeros(0, dtype=np.int64)
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    if not windows.by_length or not sizes.sum():
        return none, none, none
    ids = np.fromiter((x for d in documents for x in map(windows.vocabulary.get, d, repeat(1))), dtype=np.int64, count=int(sizes.sum()))
    document = np.repeat(np.arange(len(documents)), sizes)
    known = ids > 1
    opens = known & np.concatenate([[True], ~known[:-1] | (document[1:] != document[:-1])])
    run = np.cumsum(opens)
    keep = known & (np.bincount(run[known], minlength=run[-1] + 1)[run] >= windows.shortest)
    place = np.flatnonzero(keep)
    if not len(place):
        return none, none, none
    gap = np.flatnonzero(np.diff(run[place])) + 1  # a separator stands between runs
    symbols, origin = np.insert(ids[place], gap, 1), np.insert(place, gap, -1)
    index = FMIndex(symbols)
    starts, ends, pairs = [], [], []
    for patterns, bounds, owners in windows.by_length:
        pattern, position = index.find(patterns)
        start = origin[position]
        starts.append(start)
        ends.append(start + patterns.shape[1])
        times = bounds[pattern + 1] - bounds[pattern]
        which = np.repeat(bounds[pattern] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs.append(np.repeat(document[start], times) * len(windows.items) + owners[which])
    return np.concatenate(starts), np.concatenate(ends), np.unique(np.concatenate(pairs))


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(items.value)
        for part in chunks(batches, "text", SHARD_BYTES):
            documents = [words(t) for t in texts(part)]
            bounds = np.cumsum([0, *map(len, documents)])
            starts, ends, pairs = search_shard(documents, own)
            edge = np.zeros(bounds[-1] + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            covered, spans = np.cumsum(edge)[:-1] > 0, [[] for _ in documents]
            for k in np.unique(np.searchsorted(bounds, starts, "right") - 1).tolist():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], covered[bounds[k] : bounds[k + 1]].astype(np.int8), [0]])))
                spans[k] = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
            found: list[list[str]] = [[] for _ in documents]
            for pair in pairs.tolist():
                found[pair // len(own.items)].append(own.items[pair % len(own.items)])
            columns = [*part.columns, pa.array(np.diff(bounds), pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "n_words", "spans", "items"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts words, and merges the spans of all passes."""
    for part in chunks(batches, "text", SHARD_BYTES):
        place, spans = part.schema.get_field_index("spans"), []
        for own in part.column(place).to_pylist():
            out: list[dict] = []
            for s in sorted(own or [], key=lambda s: s["start"]):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            spans.append(out)
        counts = pa.array([len(words(t)) for t in texts(part)], pa.int64())
        items = pa.array([x or [] for x in part.column(place + 1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*part.columns[:place], counts, pa.array(spans, _SPAN_TYPE), items], [*part.schema.names[:place], "n_words", "spans", "items"])


def leaks(docs: DataFrame, benchmark: DataFrame, *more: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """(doc_id, text binary, the columns ``more`` of ``docs``, n_words, spans, items) for every row: hit word spans
    [start, end) and the items found.

    A window is 8 consecutive words of an item; an item of fewer words, but not none, is one window.  Null texts have no
    words; a null item_id is named by the empty string; items that share an id count once; an empty benchmark hits
    nothing.  A shard is at least one whole document, however long.  Repeated rows are searched like any others.  An empty
    table gives an empty result.  ``then`` takes the batches of these columns further in the same worker, to ``schema``.
    """
    spark = docs.sparkSession
    last = then or (lambda batches: batches)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes().alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).head()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    rows = docs.select("doc_id", text_bytes().alias("text"), *more)
    kinds = dict(docs.dtypes)
    base = f"doc_id {kinds['doc_id']}, text binary" + "".join(f", `{c}` {kinds[c]}" for c in more)
    found = f", n_words long, spans {_STATE}, items array<string>"

    def search(where) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return _pass(spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in items.where(where).collect()]))

    if blocks == 1:
        run = search(F.lit(True))
        return rows.mapInArrow(lambda batches: last(run(batches)), schema or base + found)
    path = f"{shared_folder(spark)}/leaks-{uuid.uuid4()}"
    keys = [F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id_hash"), F.xxhash64(F.lit(3), "text").alias("text_hash")]
    own = docs.select(*keys, text_bytes().alias("text"))
    for block in range(blocks):
        hit = own.mapInArrow(search(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block), "id_hash long, text_hash long, text binary" + found)
        hit.where(F.size("items") > 0).select("id_hash", "text_hash", "spans", "items").distinct().write.mode("append").parquet(path)
    both = spark.read.schema(f"id_hash long, text_hash long, spans {_STATE}, items array<string>").parquet(path).groupBy("id_hash", "text_hash").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    keyed = docs.select("doc_id", text_bytes().alias("text"), *more, *keys)
    return keyed.join(both, ["id_hash", "text_hash"], "left").select(*rows.columns, "spans", "items").mapInArrow(lambda batches: last(_merged(batches)), schema or base + found)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of counts and digests for each row of ``docs``; see ``leaks``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks(docs, benchmark).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them; the rest as it is."""
    words_at, out, place = [m.span() for m in _TOKEN.finditer(text)], [], 0
    for s in spans:
        out.append(text[place : words_at[s["start"]][0]])
        place = words_at[s["end"] - 1][1]
    return b"".join([*out, text[place:]])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) without leaks: those with windows of two items or more go, and from
    those with windows of one the hit words are cut.  All others stay as they are, null texts and repeated rows included;
    long texts are cut whole.  Other columns of ``docs`` are left out.  An empty table gives an empty result."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(pa.array([len(x) < 2 for x in part.column(8).to_pylist()], pa.bool_()))
            spans = part.column(7).to_pylist()
            out = [without_spans(t, s) if s else t for t, s in zip(texts(part), spans)]
            changed = pa.array([len(s) > 0 for s in spans], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), *part.columns[2:6], changed], [*part.schema.names[:6], "changed"])

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, text binary, lang {kinds['lang']}, source {kinds['source']}, n_chars {kinds['n_chars']}, missing boolean, changed boolean"
    done = leaks(docs.withColumn("missing", F.col("text").isNull()), benchmark, "lang", "source", "n_chars", "missing", then=cut, schema=schema)
    text = F.when(~F.col("missing"), F.col("text").cast("string"))
    n = F.when(F.col("changed"), F.char_length(F.col("text").cast("string")).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS size, array_to_string(w[i:i + 7], ' ') AS g
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows), grams AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM docs, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS i)
), hits AS (SELECT r, item_id, i, size FROM grams JOIN windows USING (size, g)
), found AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM hits GROUP BY r
), covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN found USING (r) LEFT JOIN covered USING (r)
"""
