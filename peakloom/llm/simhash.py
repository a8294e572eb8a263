"""SimHash near-duplicates found through sharded vantage-point trees.

Fingerprints are 64-bit.  Two of them within ``max_bits`` differing bits agree within ``max_bits // bands`` bits on at
least one of ``bands`` equal bit ranges, so each range gets a vantage-point tree of its own over the Hamming distance of
that range.  The tree is built on the driver from a bounded sample (``TREE_SAMPLE`` fingerprints); it only decides where
rows go, never which pairs are found.  Every fingerprint lives in one shard (its leaf) and queries each shard that the
triangle bound can't rule out, i.e. the leaves whose boundary lies within the query radius.  A shard that is too large for
one sample's resolution is split by a subtree over a sample of its own rows, built and applied on the executors, and so on
until no shard is too large or none can be split, so that a shard's size doesn't grow with the table.  Inside a shard all
64 bits are compared, and only a spanning forest of the links found there is emitted.  Shards that stay large (their
fingerprints are alike) are cut into a grid of (stored block, querying block) cells, which together still compare every
pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, chunks, hash_share, mixed, text_bytes, texts
from .components import connected_components

SEED = 42
MAX_BITS = 3
BANDS = 2
#: Fingerprints from which a tree's vantage points and radii are taken, and those from which a shard's subtree is.
TREE_SAMPLE, SUBTREE_SAMPLE = 65_536, 8192
#: Sampled fingerprints that a leaf has at least, so that its share of all rows is about what the sample says.
LEAF_SAMPLE = 16
#: Stored fingerprints that a leaf should hold, from how many on a shard is split, and rows of a cell's two sides.
LEAF_ROWS, SPLIT_ROWS, CELL_ROWS = 768, 8192, 16_384

_LANES = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], dtype=np.uint8).view(np.uint64).ravel()


def simhash(text: bytes) -> int:
    """The fingerprint of one text: lower-case words, 3-word shingles, a bit where over half the XXH64 values have it."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(words, words[1:], words[2:]) if len(words) >= 3 else [words]
    n = max(1, len(words) - 2)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), dtype=np.uint64, count=n)
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # a lane of eight bits holds 255 at most
    ones = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        prints = np.array([simhash(t) for t in texts(part)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print long) for every row; a null text counts as empty and has print 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, print long"
    )


def hex_print(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


class Tree:
    """A vantage-point tree in flat arrays.  A point goes left if its distance to the vantage point is <= radius."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.point, self.radius, self.left, self.right, self.n_leaves = [], [], [], [], 0
        self.root = self._grow(sample, max(2, leaf_rows), np.random.default_rng(7))

    def _grow(self, part: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        """The id of a node (>= 0) or of a leaf (coded -1 - leaf)."""
        best = None
        if len(part) > leaf_rows:
            for point in part[rng.integers(0, len(part), 6)]:
                d = np.bitwise_count(part ^ point).astype(np.int64)
                radius = int(np.median(d))
                share = float((d <= radius).mean())
                near = float((np.abs(d - radius) <= 1).mean())
                if 0.05 < share < 0.95 and (best is None or near + abs(share - 0.5) < best[0]):
                    best = (near + abs(share - 0.5), point, radius, d <= radius)
        if best is None:
            self.n_leaves += 1
            return -self.n_leaves
        node = len(self.point)
        for column in (self.point, self.radius, self.left, self.right):
            column.append(0)
        self.point[node], self.radius[node] = best[1], best[2]
        self.left[node] = self._grow(part[best[3]], leaf_rows, rng)
        self.right[node] = self._grow(part[~best[3]], leaf_rows, rng)
        return node

    def reach(self, points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that may hold a point within ``slack``; slack 0 gives each row's own leaf."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - node))
                continue
            d = np.bitwise_count(points[own] ^ self.point[node]).astype(np.int64)
            todo.append((self.left[node], own[d - slack <= self.radius[node]]))
            todo.append((self.right[node], own[d + slack > self.radius[node]]))
        empty = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(rows or empty), np.concatenate(leaves or empty)


def _band(prints: np.ndarray, band: int, bands: int) -> np.ndarray:
    width = 64 // bands
    return (prints >> np.uint64(band * width)) & np.uint64((1 << width) - 1)


class _Root:
    """Union-find over rows of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def cell_forest(stored: np.ndarray, asking: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of fingerprints, as star edges to each tree's smallest value."""
    values = np.unique(np.concatenate([stored, asking]))
    at, root = np.searchsorted(values, stored), _Root(len(values))
    label = np.arange(len(values))  # each value's tree as of the last block: links inside a tree need no more work
    step = max(1, (1 << 20) // max(1, len(stored)))
    for k in range(0, len(asking), step):
        block = asking[k : k + step]
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ stored[None, :]) <= max_bits)
        x, y = label[np.searchsorted(values, block)[i]], label[at[j]]
        fresh = x != y
        if fresh.any():
            for pair in np.unique(x[fresh] * len(values) + y[fresh]).tolist():
                root.join(*divmod(pair, len(values)))
            label = np.array([root.find(v) for v in label.tolist()], dtype=np.int64)
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def _leaf_rows(n: int, sampled: int) -> int:
    return max(LEAF_SAMPLE, LEAF_ROWS * sampled // max(1, n))


def _split(rows: DataFrame, bands: int, slack: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of shards that are done, rows of shards that were split): those with over ``SPLIT_ROWS`` stored fingerprints.

    A shard's subtree comes from at most about ``SUBTREE_SAMPLE`` of its rows, in one group; it is applied to blocks of the
    shard's rows, so no task holds a whole shard.  New shards are named by a hash of the old name and the leaf: should two
    names ever be equal, shards only merge.  A shard whose subtree has one leaf stays as it is."""
    large = rows.where("NOT asks").groupBy("shard", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT_ROWS)
    share = F.lit(1 << 32) * (F.lit(SUBTREE_SAMPLE) / F.col("n"))
    sample = rows.where("NOT asks").join(large, ["shard", "band"]).where(F.pmod(F.xxhash64(F.lit(31), "print"), F.lit(1 << 32)) < share)

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        band, n = int(frame["band"].iloc[0]), int(frame["n"].iloc[0])
        tree = Tree(_band(np.sort(frame["print"].to_numpy(np.int64).view(np.uint64)), band, bands), _leaf_rows(n, len(frame)))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "n": [n], "tree": [pickle.dumps(tree)]})[: int(tree.n_leaves > 1)]

    trees = checkpoint(sample.groupBy("shard").applyInPandas(grown, "shard long, n long, tree binary"))
    if trees.isEmpty():
        return rows, None
    parts = F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("long")
    sizes = trees.select("shard", parts.alias("parts"))
    dealt = rows.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts"))).select("shard", "part", "band", "asks", "print")
    copies = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))

    def routed(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"shard": [], "band": [], "asks": [], "print": []})]
        if len(own) and len(trees):
            tree, band = pickle.loads(trees["tree"].iloc[0]), int(own["band"].iloc[0])
            prints, asks = own["print"].to_numpy(np.int64).view(np.uint64), own["asks"].to_numpy(bool)
            for side in (False, True):
                of_side = prints[asks == side]
                row, leaf = tree.reach(_band(of_side, band, bands), slack if side else 0)
                name = mixed(mixed(leaf.astype(np.uint64) + np.uint64(1 << 32)) + np.uint64(3 * int(own["shard"].iloc[0]) & 0xFFFFFFFFFFFFFFFF))
                out.append(pd.DataFrame({"shard": name.view(np.int64), "band": band, "asks": side, "print": of_side[row].view(np.int64)}))
        return pd.concat(out)

    split = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(routed, "shard long, band int, asks boolean, print long")
    return rows.join(trees.select("shard"), "shard", "left_anti"), checkpoint(split)


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, bands: int = BANDS) -> DataFrame:
    """(a, b) links whose transitive closure is that of all pairs of distinct ``print`` values within ``max_bits``."""
    spark = prints.sparkSession
    n = prints.count()
    sample = np.sort(hash_share(prints.select("print"), ["print"], TREE_SAMPLE, n).toPandas()["print"].to_numpy(np.int64).view(np.uint64))
    trees = [Tree(_band(sample, k, bands), _leaf_rows(n, len(sample))) for k in range(bands)]
    forest = spark.sparkContext.broadcast(trees)
    slack = max_bits // bands

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["print"].to_numpy(np.int64).view(np.uint64)
            for band, tree in enumerate(forest.value):
                for asks in (False, True):
                    row, leaf = tree.reach(_band(own, band, bands), slack if asks else 0)
                    yield pd.DataFrame({"shard": leaf * bands + band, "band": band, "asks": asks, "print": own[row].view(np.int64)})

    todo, done = prints.select("print").mapInPandas(routed, "shard long, band int, asks boolean, print long"), []
    while todo is not None:
        whole, todo = _split(todo, bands, slack)
        done.append(whole)
    rows = reduce(DataFrame.unionByName, done)
    size = rows.groupBy("shard").agg(
        F.ceil(F.count(F.when(~F.col("asks"), 1)) / F.lit(CELL_ROWS)).cast("int").alias("n_stored"),
        F.ceil(F.count(F.when(F.col("asks"), 1)) / F.lit(CELL_ROWS)).cast("int").alias("n_asking"),
    )
    mine, other = F.when(F.col("asks"), F.col("n_asking")).otherwise(F.col("n_stored")), F.when(F.col("asks"), F.col("n_stored")).otherwise(F.col("n_asking"))
    cells = (
        rows.join(size.where("n_stored > 0"), "shard")
        .withColumn("own", F.pmod(F.xxhash64("print"), mine.cast("long")).cast("int"))
        .withColumn("cross", F.explode(F.sequence(F.lit(0), other - 1)))
        .select("shard", F.when(F.col("asks"), F.col("cross")).otherwise(F.col("own")).alias("i"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("cross")).alias("j"), "asks", "print")
    )

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        values, asks = frame["print"].to_numpy(np.int64).view(np.uint64), frame["asks"].to_numpy(bool)
        a, b = cell_forest(values[~asks], values[asks], max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("shard", "i", "j").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text; other columns are not read).

    Null text: empty, fingerprint zero, linked like any other.  component_id is the smallest doc_id reachable over links
    of at most ``max_bits`` differing bits.  Rows that repeat a doc_id each keep their own fingerprint; a null doc_id
    never is the smallest unless all ids of its component are null.  An empty table gives an empty result.
    """
    own = checkpoint(fingerprints(docs.select("doc_id", "text")))
    least = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))
    return own.join(_named(own, least, max_bits), "print").select("doc_id", hex_print("print").alias("fingerprint"), F.col("least.id").alias("component_id"))


def _named(own: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """(print, least) of the prints of ``own``: the component's smallest ``least``."""
    prints = checkpoint(own.groupBy("print").agg(F.min(least).alias("own_least")))
    links = connected_components(near_links(prints, max_bits))
    rooted = prints.join(links, prints["print"] == links["node"], "left").select("print", "own_least", F.coalesce("root", "print").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("own_least").alias("least")), "root").select("print", "least")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and any other columns), all columns as they are.

    The row with the smallest doc_id stays, null ids last; of rows that share it one, chosen by a hash of the text and,
    of equal texts, by the other columns.  Null texts count as empty.  Texts are hashed once, whatever their length; an
    empty table gives an empty result.  The rows of a component never meet: only the chosen ids do, and repeats of a
    chosen row are reduced to one before they are exchanged."""
    id_of, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__id": F.coalesce(id_of, F.lit(-1).cast("long")), "__key": F.xxhash64(id_of.isNull(), text)})
    own = keyed.select("__id", "__key", id_of.isNull().alias("missing"), text.cast("binary").alias("text")).mapInArrow(_keyed_prints, "__id long, __key long, missing boolean, print long")
    own = checkpoint(own)
    chosen = _named(own, F.struct("missing", "__id", "__key"), max_bits).select("least.__id", "least.__key").distinct()
    place = W.partitionBy("__id", "__key").orderBy(*[F.hash(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in docs.dtypes if not k.startswith("map")])
    kept = keyed.join(chosen, ["__id", "__key"], "left_semi").withColumn("__rank", F.row_number().over(place)).where("__rank = 1")
    return kept.select(*docs.columns)


def _keyed_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        prints = np.array([simhash(t) for t in texts(part)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(prints)], ["__id", "__key", "missing", "print"])
