"""Fragment index search and hyperscores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import PROTON
from ..functions.mass import log_bin, log_factorial
from .joins import match
from .windows import longest_run


def fragment_index(fragments: DataFrame, ppm: float = 20.0) -> DataFrame:
    """(bin, pep_id, mz): the inverted index, an equi-joinable table."""
    return fragments.where(F.col("mz") > 0).select(log_bin(F.col("mz").cast("double"), ppm).alias("bin"), "pep_id", "mz")


def bin_idf(index: DataFrame) -> DataFrame:
    """(bin, n, idf): ln(1 + peptides / (postings + 1)) as float."""
    total = index.agg(F.count_distinct("pep_id").alias("__n"))
    counts = index.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select("bin", "n", F.ln(1 + F.col("__n") / (F.col("n") + 1)).cast("float").alias("idf"))


def index_search(peaks: DataFrame, index: DataFrame, ppm: float = 20.0, tolerance: float = 20.0, least: int = 2, top: int = 10, precursors: DataFrame | None = None) -> DataFrame:
    """(spectrum, pep_id, score, n_matched, rank): sum of sqrt(intensity) * idf over all postings of all bins a peak touches.

    With ``precursors`` (spectrum, mass) each peak is also looked up at its complement mass + 2 protons - m/z.  Peaks of no
    intensity weigh nothing; a peptide with two fragments in reach counts twice; ties rank by pep_id."""
    probes = peaks.select("spectrum", "mz", "intensity")
    if precursors is not None:
        other = probes.join(precursors, "spectrum").select("spectrum", (F.col("mass") + 2 * PROTON - F.col("mz")).alias("mz"), "intensity")
        probes = probes.unionByName(other.where("mz > 0"))
    t = tolerance / 1e6
    low, high = log_bin(F.col("mz") * (1 - t), ppm), log_bin(F.col("mz") * (1 + t), ppm)
    weight = F.when(F.col("intensity") > 0, F.sqrt("intensity")).otherwise(0.0)
    dealt = probes.where("mz > 0").select("spectrum", weight.alias("w"), F.explode(F.sequence(low, high)).alias("bin"))
    scored = dealt.join(index.join(bin_idf(index).select("bin", "idf"), "bin"), "bin")
    found = scored.groupBy("spectrum", "pep_id").agg(F.sum(F.col("w") * F.col("idf")).alias("score"), F.count(F.lit(1)).alias("n_matched")).where(F.col("n_matched") >= least)
    rank = F.row_number().over(W.partitionBy("spectrum").orderBy(F.round("score", 6).desc(), "pep_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def hyperscore(fragments: DataFrame, peaks: DataFrame, ppm: float = 20.0) -> DataFrame:
    """Both hyperscores, counts by ion and charge, and longest singly charged runs, by peptide.

    fragments: pep_id, ion_type, position, charge, mz; each takes its nearest peak.  Peptides without a match are left out."""
    own = fragments.withColumn("target_mz", F.col("mz").cast("double")).drop("mz")
    got = match(own, peaks, ppm, "neighbor", ["pep_id", "ion_type", "position", "charge"])
    b, y, one = F.col("ion_type") == 0, F.col("ion_type") == 1, F.col("charge") == 1
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("intensity"))), F.lit(0.0))
    facts = got.groupBy("pep_id").agg(
        n(b).alias("n_b"), n(y).alias("n_y"), n(b & one).alias("n_b_z1"), n(y & one).alias("n_y_z1"), n(b & ~one).alias("n_b_z2"), n(y & ~one).alias("n_y_z2"), total(b).alias("sum_b"), total(y).alias("sum_y")
    )
    run = longest_run(got.where(one), ["pep_id", "ion_type"], "position", "__r").groupBy("pep_id").agg(F.max(F.when(b, F.col("__r"))).alias("longest_b"), F.max(F.when(y, F.col("__r"))).alias("longest_y"))
    facts = facts.join(run, "pep_id", "left").fillna(0, ["longest_b", "longest_y"])
    shared = log_factorial(F.col("n_b")) + log_factorial(F.col("n_y"))
    return facts.select(
        "pep_id", (F.ln(F.col("sum_b") + F.col("sum_y") + 1) + shared).alias("hs_add"), (F.ln(F.col("sum_b") + 1) + F.ln(F.col("sum_y") + 1) + shared).alias("hs_mul"),
        (F.col("n_b") + F.col("n_y")).alias("n_matched"), "n_b_z1", "n_y_z1", "n_b_z2", "n_y_z2", "longest_b", "longest_y", (F.col("sum_b") + F.col("sum_y")).alias("sum_matched"),
    )
