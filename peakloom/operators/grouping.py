"""Co-eluting peaks around reference peaks, and composite spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import tolerance_join
from .windows import runs, shared_checkpoints

#: Peaks within so many ppm are one m/z.
SAME_PPM = 11.0
NEAR = "ref_id long, peak_id long, profile int, mz double, scan int, intensity double"


def neighborhood(references: DataFrame, peaks: DataFrame, ppm: float = 10.0, scan_window: int = 5) -> DataFrame:
    """Peaks within three times ``ppm`` and ``scan_window`` scans of each reference (ref_id, ref_mz, ref_scan)."""
    where = F.abs(F.col("scan") - F.col("ref_scan")) <= scan_window
    return tolerance_join(references, peaks.select("peak_id", "scan", "mz", "intensity"), 3 * ppm, "ref_mz", "mz", where)


def assign(frame: pd.DataFrame) -> pd.DataFrame:
    """Numbers the m/z groups of one reference's peaks: greedy in peak order, then each peak to the nearest centre."""
    frame = frame.sort_values("peak_id", kind="stable")
    mz = frame["mz"].to_numpy()
    left, centers = np.ones(len(mz), dtype=bool), []
    for k in range(len(mz)):
        if left[k]:
            got = left & (np.abs(mz - mz[k]) <= mz[k] * SAME_PPM / 1e6)
            centers.append(mz[got].mean())
            left &= ~got
    centers = np.array(centers)
    off = np.abs(mz[:, None] - centers[None, :])
    off[off > centers[None, :] * SAME_PPM / 1e6] = np.inf
    best = off.argmin(axis=1)
    frame = frame.assign(profile=np.where(np.isfinite(off.min(axis=1)), best, -1), center=centers[best])
    return frame[frame["profile"] >= 0][["ref_id", "peak_id", "profile", "center", "mz", "scan", "intensity"]]


def rt_profiles(references: DataFrame, peaks: DataFrame, ppm: float = 10.0, scan_window: int = 5) -> DataFrame:
    """(ref_id, profile, center, scan, intensity): chromatograms of the m/z groups around each reference; zeros are absent.

    A reference's neighbourhood is bounded by its m/z and scan windows, so one task holds little whatever the run's size.
    The result is checkpointed: what follows reads it several times, and the groups are made once."""
    near = neighborhood(references, peaks, ppm, scan_window).select("ref_id", "peak_id", "mz", "scan", "intensity")
    own = near.groupBy("ref_id").applyInPandas(assign, "ref_id long, peak_id long, profile int, center double, mz double, scan int, intensity double")
    shared_checkpoints(peaks.sparkSession)
    return own.groupBy("ref_id", "profile", "center", "scan").agg(F.sum("intensity").alias("intensity")).checkpoint()


def coeluting(profiles: DataFrame, least: float = 0.8) -> DataFrame:
    """(ref_id, profile, center, similarity, together): cosine with the reference's first profile, which always is together."""
    first = profiles.where("profile = 0").select("ref_id", "scan", F.col("intensity").alias("y"))
    norms = profiles.groupBy("ref_id", "profile", "center").agg(F.sum(F.col("intensity") * F.col("intensity")).alias("xx"))
    dots = profiles.join(first, ["ref_id", "scan"]).groupBy("ref_id", "profile").agg(F.sum(F.col("intensity") * F.col("y")).alias("xy"))
    base = norms.where("profile = 0").select("ref_id", F.col("xx").alias("yy"))
    both = norms.join(base, "ref_id").join(dots, ["ref_id", "profile"], "left")
    norm = F.sqrt("xx") * F.sqrt("yy")
    cosine = F.when(norm > 0, F.least(F.lit(1.0), F.coalesce("xy", F.lit(0.0)) / F.nullif(norm, F.lit(0.0)))).otherwise(0.0)
    return both.select("ref_id", "profile", "center", cosine.alias("similarity"), ((F.col("profile") == 0) | (cosine >= least)).alias("together"))


def grouped_peaks(references: DataFrame, peaks: DataFrame, ppm: float = 10.0, scan_window: int = 5, least: float = 0.8) -> DataFrame:
    """(ref_id, peak_id): peaks in the scan window within 11 ppm of a co-eluting centre.

    References of one m/z and scan have the same peaks, which are found once; the pairs are laid beside the references last,
    unsorted and not exchanged.  Only an id that several m/z or scans have needs its pairs compared."""
    shared_checkpoints(peaks.sparkSession)
    alike = ["ref_mz", "ref_scan"]
    few = references.select(*alike).distinct().withColumn("ref_id", F.monotonically_increasing_id()).checkpoint()  # so numbers stay
    chosen = coeluting(rt_profiles(few, peaks, ppm, scan_window), least).where("together").select("ref_id", "center")
    chosen = chosen.join(few, "ref_id")
    where = F.abs(F.col("scan") - F.col("ref_scan")) <= scan_window
    found = tolerance_join(chosen, peaks.select("peak_id", "scan", "mz"), SAME_PPM, "center", "mz", where).select(F.col("ref_id").alias("__of"), "peak_id").distinct()
    own = references.join(few.withColumnRenamed("ref_id", "__of").hint("merge"), alike).groupBy("ref_id").agg(F.collect_set("__of").alias("__all"))
    out = own.where(F.size("__all") == 1).select("ref_id", F.element_at("__all", 1).alias("__of")).join(found.hint("merge"), "__of").select("ref_id", "peak_id")
    more = own.where(F.size("__all") > 1).select("ref_id", F.explode("__all").alias("__of")).join(found.hint("merge"), "__of").select("ref_id", "peak_id").distinct()
    return out.unionByName(more)


def _merge(ppm: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group_id", "run", "mz"], kind="stable")
        other = (frame["group_id"] != frame["group_id"].shift()) & frame["group_id"].notna()  # a missing group is alone in its bucket
        opens = other | (frame["run"] != frame["run"].shift())
        out, mean, total, n, first, chain = [], 0.0, 0.0, 0, 0, None
        for row, (at, mz, intensity, k) in enumerate(zip(opens.cumsum(), *(frame[c].tolist() for c in ("mz", "intensity", "n")))):
            if n and at == chain and abs(mz - mean) <= mean * ppm / 1e6:
                mean, total, n = (mean * n + mz * k) / (n + k), total + intensity, n + k
            else:
                if n:
                    out.append((first, mean, total, n))
                mean, total, n, first, chain = mz, intensity, k, row, at
        out.append((first, mean, total, n))
        made = pd.DataFrame(out, columns=["group_id", "mz", "intensity", "n"])
        return made.assign(group_id=frame["group_id"].to_numpy()[made["group_id"]])

    return run


def composite(peaks: DataFrame, ppm: float = 10.0) -> DataFrame:
    """(group_id, mz, intensity, n): peaks of a group merged in m/z order while they are near the running mean.

    Peaks of one m/z go together, so they are added up first.  Gaps wider than the tolerance can't be bridged, so groups are
    cut there and only chains reach Python, many in one call."""
    own = peaks.select("group_id", "mz", "intensity")
    usual = F.coalesce((F.col("mz") >= 0) & ~F.isnan("mz"), F.lit(False))  # others are near nothing, not even their like
    odd = own.where(~usual).select("group_id", "mz", "intensity", F.lit(1).alias("n"))
    own = own.where(usual).groupBy("group_id", "mz").agg(F.sum("intensity").alias("intensity"), F.count(F.lit(1)).cast("int").alias("n"))
    o = W.partitionBy("group_id").orderBy("mz")
    gap = ~F.coalesce(F.col("mz") - F.lag("mz").over(o) <= F.col("mz") * ppm / 1e6, F.lit(False))
    own = runs(own, ["group_id"], [F.col("mz")], gap)
    own = own.withColumn("__rows", F.count(F.lit(1)).over(W.partitionBy("group_id", "run")))
    alone = own.where("__rows = 1").select("group_id", "mz", "intensity", "n")
    parts = int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.where("__rows > 1").select("group_id", "run", "mz", "intensity", "n", F.when(F.col("group_id").isNotNull(), F.pmod(F.xxhash64("group_id", "run"), F.lit(4 * parts))).alias("__bucket"))
    chains = dealt.repartition(parts, "__bucket").groupBy("__bucket").applyInPandas(_merge(ppm), f"group_id {dict(peaks.dtypes)['group_id']}, mz double, intensity double, n int")
    return alone.unionByName(odd).unionByName(chains)
