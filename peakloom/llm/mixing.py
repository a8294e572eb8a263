"""Mixing sources to target weights by the cube method.

A document's rate is its source's target over its source's size, from 0 to 2.  Its whole part is copies that are sure; its
fraction is the inclusion probability of one more copy.  The cube method moves the fractions of a block of documents
through the null space of two constraints (the copies' words and the number of copies), so that both totals stay as they
are, until at most two documents of the block stay fractional.  Those go on to the next round's blocks of the same source,
a few hundred times fewer each round, until the source has one last block, whatever other sources have.  Its flight leaves out ``RESERVE`` documents from the
largest to the smallest, so that the landing problem (16 documents at most) has choices of every size; all of them are tried and the
nearest to the target is taken.  A block has a bounded number of rows whatever its source's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Documents that a block holds on average.
BLOCK_ROWS = 1000
#: Documents of a source's last block that the flight leaves to the landing problem, from the largest to the smallest.
RESERVE = 14
SEED = 11
_CLOSE = 1e-9


def size(text: str = "text") -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one row for each source.

    Sources by code point, null last, weigh 5, 2, 1, repeating.  What exceeds a source's cap of twice its size is reshared
    by weight among those below theirs.  Sorted by cap over weight, the capped sources come first, so running sums give
    the level at which the rest share.  A source without words has target 0."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(by_name) - 1
    ranked = total.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    left = SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("capped", MOST * F.col("source_size") <= F.col("level") * F.col("w"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)  # the first that isn't capped
    return ranked.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("capped"), MOST * F.col("source_size")).otherwise(F.col("free") * F.col("w")).cast("double").alias("target")
    )


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities until two at most are fractional, keeping sum(p * sizes) and sum(p)."""
    p = p.copy()
    window = [k for k in range(len(p)) if _CLOSE < p[k] < 1 - _CLOSE]
    held, later = window[:3], iter(window[3:])
    while len(held) == 3:
        x = sizes[held]
        move = np.array([x[1] - x[2], x[2] - x[0], x[0] - x[1]])  # sums to nothing, and so do its words
        if not move.any():  # equal sizes: any exchange between two keeps both
            move = np.array([1.0, -1.0, 0.0])
        move = move / np.abs(move).max()
        now = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(move > 0, (1 - now) / move, np.where(move < 0, -now / move, np.inf)))
            down = np.min(np.where(move > 0, now / move, np.where(move < 0, (now - 1) / move, np.inf)))
        step = up if rng.random() * (up + down) < down else -down
        now = np.clip(now + step * move, 0, 1)
        now[now < _CLOSE], now[now > 1 - _CLOSE] = 0, 1
        p[held] = now
        held = [k for k, v in zip(held, now) if 0 < v < 1]
        while len(held) < 3 and (k := next(later, None)) is not None:
            held.append(k)
    return p


def land(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each fraction to 0 or 1: of all choices the one whose words, then whose number of copies, are nearest to what they are."""
    loose = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(loose))[:, None] >> np.arange(len(loose))) & 1
    words = np.round(np.abs(choices @ sizes[loose] - p[loose] @ sizes[loose]), 6)
    p = p.copy()
    p[loose] = choices[np.lexsort((np.abs(choices.sum(axis=1) - p[loose].sum()), words))[0]]
    return p


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """Flies one block; where its source has no other, the fractions land as well."""
    last = frame["blocks"].iloc[0] == 1
    frame = frame.sort_values(["name", "doc_id", "size"], na_position="first", kind="stable").drop(columns=["block", "blocks"])
    sizes, p = frame["size"].to_numpy(np.float64), frame["p"].to_numpy(np.float64).copy()
    flying = np.arange(len(p))
    if last:
        n = min(len(p), RESERVE // 2)
        spread = np.concatenate([np.geomspace(1, len(p), n), np.linspace(1, len(p), n)]).astype(np.int64) - 1
        flying = np.setdiff1d(flying, np.argsort(-sizes, kind="stable")[spread])
    p[flying] = flight(p[flying], sizes[flying], np.random.default_rng([SEED, int(frame["name"].iloc[0]) & 0xFFFFFFFF, len(frame)]))
    return frame.assign(p=land(p, sizes) if last else p)


def copies(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size) rows -> the same rows with source_size, target and copies (0, 1 or 2).

    Rows that repeat an id and a size are interchangeable, so reruns agree as multisets.  Documents without words are never copied for their fraction.  An empty table stays empty."""
    rated = sizes.join(targets(sizes).withColumnRenamed("source", "name_of"), F.col("source").eqNullSafe(F.col("name_of"))).drop("name_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(rate + _CLOSE)
    part = F.when((F.col("size") > 0) & (rate - sure > _CLOSE), rate - sure).otherwise(F.lit(0.0))
    kept = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    rows = checkpoint(
        rated.withColumn("sure", sure.cast("long")).withColumn("p", part).withColumn("name", F.xxhash64(F.lit(SEED), "doc_id", "size"))
    )
    schema, done, loose = rows.schema, rows.where("p = 0"), rows.where("p > 0")
    while True:
        count = loose.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("blocks"))
        most = count.agg(F.max("blocks")).head()[0]
        if most is None:
            break
        dealt = loose.join(count.withColumnRenamed("source", "name_of"), F.col("source").eqNullSafe(F.col("name_of"))).drop("name_of")
        block = F.pmod(F.xxhash64(F.lit(SEED), "name"), F.col("blocks"))
        moved = checkpoint(dealt.withColumn("block", block).groupBy("source", "block").applyInPandas(_block, schema))
        done = done.unionByName(moved.where("p = 0 OR p = 1"))
        loose = moved.where("p > 0 AND p < 1")
        if most == 1:
            break
    return done.select("doc_id", "source", "size", "source_size", "target", *kept, (F.col("sure") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; taken counts the words of all copies."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size().alias("size"))
    return copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that the mix takes, with copies and taken (their words).

    Rows are known by two hashes of id, source and text; rows that are equal in all three share their copies evenly."""
    row = ("doc_id", "source", "text")
    rows = docs.withColumn("size", size()).withColumn("k1", F.xxhash64(*row)).withColumn("k2", F.xxhash64(F.lit(1), *row))
    sizes = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size", "k1", "k2")
    chosen = copies(sizes).where("copies > 0").groupBy("k1", "k2").agg(F.sum("copies").alias("all"))
    equal = W.partitionBy("k1", "k2")
    number, count = F.row_number().over(equal.orderBy("lang", "n_chars")), F.count(F.lit(1)).over(equal)
    share = F.floor(F.col("all") / F.col("count")).cast("long") + F.when(F.col("number") <= F.col("all") % F.col("count"), 1).otherwise(0)
    rows = rows.join(chosen, ["k1", "k2"]).withColumn("number", number).withColumn("count", count).withColumn("copies", share).where("copies > 0")
    return rows.select("doc_id", "text", "lang", "source", "n_chars", "copies", (F.col("copies") * F.col("size")).alias("taken"))
