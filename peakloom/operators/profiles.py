"""Chromatograms and profiles: sums over tolerance matches, and shapes of ordered profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.isotopes import pearson
from .joins import tolerance_join
from ..params import FWHM_SIGMA
from .windows import quantiles, runs


#: Quadrupole centres of a profile at most: two decimals over the widest window.
MOST_CENTERS = 10_000


def xic(targets: DataFrame, peaks: DataFrame, ppm: float = 10.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(pep_id, frag_id, target_mz, scan, intensity, mass_sum, n): a sparse chromatogram; absent scans are zero.

    targets: pep_id, frag_id, target_mz and the columns to ``carry``, the same in all rows of a fragment; peaks: scan, mz, intensity.  Peaks of one m/z and scan are added up first, and
    targets of one m/z share a chromatogram, so pairs grow with distinct m/z; only the result has a row for each target."""
    added = peaks.groupBy("mz", "scan").agg(F.sum("intensity").alias("intensity"), F.sum(F.col("mz") * F.col("intensity")).alias("mass_sum"), F.count(F.lit(1)).alias("n"))
    pairs = tolerance_join(targets.select("target_mz").distinct(), added, ppm)
    found = pairs.groupBy(F.col("target_mz").alias("__target"), "scan").agg(F.sum("intensity").alias("intensity"), F.sum("mass_sum").alias("mass_sum"), F.sum("n").alias("n"))
    many = targets.groupBy("pep_id", "frag_id", "target_mz", *carry).agg(F.count(F.lit(1)).alias("__times"))
    out = many.join(found.hint("merge"), F.col("target_mz") == F.col("__target"))
    return out.select("pep_id", "frag_id", "target_mz", "scan", *[(F.col(c) * F.col("__times")).alias(c) for c in ("intensity", "mass_sum", "n")], *carry)


def alike_fragments(targets: DataFrame) -> DataFrame:
    """(pep_id, frag_id, target_mz, weight): one of each peptide's fragments that have the same m/z, and how many those are."""
    own = targets.groupBy("pep_id", "frag_id").agg(F.sort_array(F.collect_list("target_mz")).alias("__mz"))
    few = own.groupBy("pep_id", "__mz").agg(F.min("frag_id").alias("frag_id"), F.count(F.lit(1)).alias("weight"))
    return few.select("pep_id", "frag_id", F.explode("__mz").alias("target_mz"), "weight")


def _grid(fragments: DataFrame, peaks: DataFrame, name: str, places: Column, ppm: float) -> DataFrame:
    """(frag_id, name, intensity): the signal of each fragment at each of ``places`` (an array), 0 where there is none.

    Peaks of one m/z and place are added up first, fragments of one m/z share a profile, and profiles are filled before they
    are laid beside the fragments: dense rows are never exchanged.  Only an id that several rows have is added up after."""
    added = peaks.groupBy("mz", name).agg(F.sum("intensity").alias("intensity"))
    found = tolerance_join(fragments.select("target_mz").distinct(), added, ppm).groupBy("target_mz", name).agg(F.sum("intensity").alias("intensity"))
    found = found.groupBy(F.col("target_mz").alias("__target")).agg(F.map_from_entries(F.collect_list(F.struct(name, "intensity"))).alias("__at"))
    found = found.select("__target", F.transform(places, lambda p: F.struct(p.alias(name), F.coalesce(F.try_element_at("__at", p), F.lit(0.0)).alias("intensity"))).alias("__filled"))
    none = F.transform(places, lambda p: F.struct(p.alias(name), F.lit(0.0).alias("intensity")))
    own = fragments.groupBy("frag_id").agg(F.collect_list("target_mz").alias("__mz"), F.count(F.lit(1)).alias("__rows"))
    alone = (F.col("__rows") == 1) | F.col("frag_id").isNull()
    one = own.where(alone).select("frag_id", "__rows", F.when(F.col("frag_id").isNotNull(), F.get("__mz", F.lit(0))).alias("__mz"))
    one = one.join(found.hint("merge"), F.col("__mz") == F.col("__target"), "left").select("frag_id", "__rows", F.inline(F.coalesce("__filled", none)))
    # ids of several rows: each row has the sum over all of them
    more = own.where(~alone).select("frag_id", "__rows", F.explode_outer("__mz").alias("__mz")).join(found.hint("merge"), F.col("__mz") == F.col("__target"), "left")
    more = more.select("frag_id", "__rows", F.inline(F.coalesce("__filled", none))).groupBy("frag_id", "__rows", name).agg(F.sum("intensity").alias("intensity"))
    out = one.unionByName(more)
    return out.select("frag_id", name, "intensity", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))).alias("__k")).drop("__k")


def mass_errors(chromatograms: DataFrame) -> DataFrame:
    """(pep_id, frag_id, mean_ppm, std_ppm, consistency) of fragments with signal, weighted by intensity over scans."""
    own = chromatograms.where("intensity > 0").withColumn("e", (F.col("mass_sum") / F.col("intensity") - F.col("target_mz")) / F.col("target_mz") * 1e6)
    i, e = F.col("intensity"), F.col("e")
    mean = F.sum(i * e) / F.sum(i)
    facts = own.groupBy("pep_id", "frag_id").agg(mean.alias("mean_ppm"), F.sqrt(F.greatest(F.sum(i * e * e) / F.sum(i) - mean * mean, F.lit(0.0))).alias("std_ppm"))
    return facts.withColumn("consistency", F.exp(-F.col("std_ppm") / 5))


def _facts(chromatograms: DataFrame, n_scans: int, least: float, more: tuple[Column, ...] = ()) -> DataFrame:
    """A row for each fragment of some signal: pep_id, weight, top (of its peptide's sum), r (null: none counts) and ``more``.

    The chromatograms are read once: a scan's sum stands beside its rows, and the sum's own moments are added up from them."""
    own = chromatograms if "weight" in chromatograms.columns else chromatograms.withColumn("weight", F.lit(1))
    own = own.where("pep_id IS NOT NULL").withColumn("__all", F.sum(F.col("intensity") * F.col("weight")).over(W.partitionBy("pep_id", "scan")))
    x, y, w, n = F.col("intensity"), F.col("__all"), F.col("weight"), F.lit(float(n_scans))
    seen = lambda c: F.when(F.col("scan").isNotNull(), c)
    frag = own.groupBy("pep_id", "frag_id", "weight").agg(
        F.sum(seen(x)).alias("sx"), F.sum(seen(x * x)).alias("sxx"), F.sum(seen(x * y)).alias("sxy"), F.max(seen(x)).alias("most"), F.count("scan").alias("n"),
        F.sum(x * w).alias("y"), F.sum(x * w * y).alias("yy"), F.max(y).alias("top"), *more,
    )
    of_peptide = W.partitionBy("pep_id")
    frag = frag.withColumns({"sy": F.sum("y").over(of_peptide), "syy": F.sum("yy").over(of_peptide), "top": F.max("top").over(of_peptide)})
    r = pearson(n, F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    return frag.withColumn("r", F.when((F.col("n") > 0) & (F.col("most") >= least * 0.1) & (r > 0), r))


def _mean(value: Column) -> Column:
    """The mean of ``value`` over rows of some weight, nulls left out."""
    return F.sum(value * F.col("weight")) / F.sum(F.when(value.isNotNull(), F.col("weight")))


def _score(least: float) -> Column:
    enough = (F.sum(F.when(F.col("r").isNotNull(), F.col("weight"))) >= 3) & (F.max("top") >= least)
    return F.when(enough, _mean(F.col("r"))).otherwise(0.0)


def xic_scores(chromatograms: DataFrame, n_scans: int, least: float = 100.0) -> DataFrame:
    """(pep_id, xic_score): mean positive Pearson of fragments with the summed chromatogram over all ``n_scans`` scans.

    Zeros are counted in closed form, so nothing is densified.  0 unless the sum's maximum reaches ``least`` and three
    fragments (of maximum ``least`` / 10 or more) correlate.  A column ``weight`` tells how many fragments a row stands for."""
    return _facts(chromatograms, n_scans, least).groupBy("pep_id").agg(_score(least).alias("xic_score"), F.max("n").alias("__n")).where("__n > 0").drop("__n")


def combined_scores(chromatograms: DataFrame, n_scans: int, least: float = 100.0) -> DataFrame:
    """(pep_id, xic_score, mass_score, score): 0.7 of the correlation and 0.3 of mass closeness; all 0 without correlation."""
    i = F.when(F.col("intensity") > 0, F.col("intensity"))
    e = (F.col("mass_sum") / i - F.col("target_mz")) / F.col("target_mz") * 1e6
    frag = _facts(chromatograms, n_scans, least, (F.sum(i).alias("si"), F.sum(i * e).alias("sie"), F.sum(i * e * e).alias("siee")))
    mean = F.col("sie") / F.col("si")
    frag = frag.withColumn("mean_ppm", mean).withColumn("std_ppm", F.sqrt(F.greatest(F.col("siee") / F.col("si") - mean * mean, F.when(F.col("si").isNotNull(), 0.0))))
    off = F.col("mean_ppm") != 0
    both = frag.groupBy("pep_id").agg(
        _score(least).alias("xic_score"), _mean(F.when(off, F.abs("mean_ppm"))).alias("a"), _mean(F.when(off, F.col("std_ppm"))).alias("s"), _mean(F.exp(-F.col("std_ppm") / 5)).alias("c"), F.max("n").alias("__n"),
    ).where("__n > 0")
    close = F.when(F.col("a").isNull(), 0.0).otherwise(0.4 * F.exp(-F.col("a") / 5) + 0.3 * F.exp(-F.col("s") / 3) + 0.3 * F.col("c"))
    both = both.withColumn("mass_score", F.when(F.col("xic_score") == 0, 0.0).otherwise(close))
    return both.select("pep_id", "xic_score", "mass_score", F.when(F.col("xic_score") == 0, 0.0).otherwise(0.7 * F.col("xic_score") + 0.3 * F.col("mass_score")).alias("score"))


def q1_profile(fragments: DataFrame, spectra: DataFrame, peaks: DataFrame, precursor_mz: float, q1_window: float, rt: float, rt_window: float, ppm: float = 20.0) -> DataFrame:
    """(frag_id, q1, intensity): summed fragment signal at each quadrupole centre (two decimals, half to even) in reach.

    Centres whose spectra are all outside the retention window stay, with 0.  spectra: scan_id, rt_sec, q1_center; peaks:
    scan_id, mz, intensity; fragments: frag_id, target_mz."""
    near = spectra.where((F.col("q1_center") >= precursor_mz - q1_window) & (F.col("q1_center") <= precursor_mz + q1_window))
    near = near.withColumn("q1", (F.rint(F.col("q1_center") * 100) / 100).cast("float"))
    centers = near.select("q1").distinct().limit(MOST_CENTERS + 1).collect()
    if len(centers) > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} quadrupole centres in reach")
    # a dense output is asked for: each fragment has a row at every centre
    in_time = near.where(F.abs(F.col("rt_sec") - rt) <= rt_window).select("scan_id", "q1")
    return _grid(fragments, peaks.join(in_time, "scan_id").select("mz", "q1", "intensity"), "q1", F.lit([r["q1"] for r in centers]).cast("array<float>"), ppm)


def rt_profile(fragments: DataFrame, spectra: DataFrame, peaks: DataFrame, rt: float, rt_window: float, n_bins: int = 50, ppm: float = 20.0) -> DataFrame:
    """(frag_id, rt_bin, rt_sec, intensity): summed signal in ``n_bins`` left-anchored bins of width span / (n_bins - 1)."""
    width = 2 * rt_window / (n_bins - 1)
    low = rt - rt_window
    in_time = spectra.where(F.abs(F.col("rt_sec") - rt) <= rt_window).select("scan_id", F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor((F.col("rt_sec") - low) / width))).cast("int").alias("rt_bin"))
    out = _grid(fragments, peaks.join(in_time, "scan_id").select("mz", "rt_bin", "intensity"), "rt_bin", F.sequence(F.lit(0), F.lit(n_bins - 1)), ppm)
    return out.withColumn("rt_sec", F.lit(low) + F.col("rt_bin") * width)


def kernel_correlation(profile: DataFrame, key: str, position: str, center: float, sigma: float) -> DataFrame:
    """Cosine of each profile with a Gaussian around ``center``; 0 below three points or without signal."""
    d = (F.col(position) - center) / sigma
    k, i = F.exp(-0.5 * d * d), F.col("intensity")
    norm = F.sqrt(F.sum(k * k)) * F.sqrt(F.sum(i * i))
    return profile.groupBy(key).agg(F.when((F.count(F.lit(1)) >= 3) & (norm > 0), F.sum(k * i) / F.nullif(norm, F.lit(0.0))).otherwise(0.0).alias("correlation"))


# Shapes of ordered profiles (id, pos, value): pos counts from 0 without gaps, x is the position's coordinate.

def smooth(profile: DataFrame, key: str, sigma: float, truncate: float = 3.0) -> DataFrame:
    """Adds ``smoothed``: a Gaussian filter whose kernel is cut and renormalised at the edges."""
    radius = int(truncate * sigma + 0.5)
    w = W.partitionBy(key).orderBy("pos")
    value, weight = F.lit(0.0), F.lit(0.0)
    for k in range(-radius, radius + 1):
        g, there = math.exp(-0.5 * (k / sigma) ** 2), F.lead("value", k).over(w) if k > 0 else F.lag("value", -k).over(w) if k else F.col("value")
        value, weight = value + F.coalesce(there * g, F.lit(0.0)), weight + F.when(there.isNotNull(), g).otherwise(0.0)
    return profile.withColumn("smoothed", value / weight)


def auto_sigma(spacing: float, width: float = 10.0) -> float:
    """Filter width in scans for peaks ``width`` wide: a third of the sigma, between 0.5 and 10."""
    return min(10.0, max(0.5, width / 2.355 / 3 / spacing))


def fwhm(profile: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, apex_x, apex, fwhm): width at half the maximum around the first highest point, crossings interpolated.

    A side without a crossing takes the other's distance; neither, or fewer than three points: -1."""
    w = W.partitionBy(key)
    o = w.orderBy("pos")
    v = F.col(value)
    apex = F.min(F.when(v == F.col("__max"), F.col("pos"))).over(w)
    own = profile.withColumn("__max", F.max(v).over(w)).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__apex", apex)
    own = own.withColumns({"__next_x": F.lead("x").over(o), "__next_v": F.lead(v).over(o), "__prev_x": F.lag("x").over(o), "__prev_v": F.lag(v).over(o)})
    half = F.col("__max") / 2
    low = v <= half
    left, right = F.max(F.when(low & (F.col("pos") < F.col("__apex")), F.col("pos"))).over(w), F.min(F.when(low & (F.col("pos") > F.col("__apex")), F.col("pos"))).over(w)
    own = own.withColumn("__left", left).withColumn("__right", right)
    def cross(x0, v0, x1, v1):
        return F.when(F.abs(v1 - v0) <= 1e-10, x0).otherwise(x0 + (half - v0) / F.nullif(v1 - v0, F.lit(0.0)) * (x1 - x0))

    at_left = F.max(F.when(F.col("pos") == F.col("__left"), cross(F.col("x"), v, F.col("__next_x"), F.col("__next_v"))))
    at_right = F.max(F.when(F.col("pos") == F.col("__right"), cross(F.col("__prev_x"), F.col("__prev_v"), F.col("x"), v)))
    facts = own.groupBy(key).agg(F.max(F.when(F.col("pos") == F.col("__apex"), F.col("x"))).alias("apex_x"), F.max("__max").alias("apex"), at_left.alias("__l"), at_right.alias("__r"), F.max("__n").alias("__n"))
    a, left_x, right_x = F.col("apex_x"), F.col("__l"), F.col("__r")
    width = F.when(F.col("__n") < 3, -1.0).when(left_x.isNotNull() & right_x.isNotNull(), right_x - left_x).when(left_x.isNotNull(), 2 * (a - left_x)).when(right_x.isNotNull(), 2 * (right_x - a)).otherwise(-1.0)
    return facts.select(key, "apex_x", "apex", width.alias("fwhm"))


def centroid(profile: DataFrame, key: str, min_intensity: float = 1000.0, min_bins: int = 3) -> DataFrame:
    """(key, mz, intensity, precision_ppm, n_bins) of each island of positive bins that has an inner local maximum.

    The island's first such maximum of ``min_intensity`` or more gives the precision; islands under ``min_bins`` bins go."""
    o = W.partitionBy(key).orderBy("pos")
    v = F.col("value")
    own = profile.withColumns({"__p": F.lag("value").over(o), "__q": F.lead("value").over(o)})
    apex = (v >= min_intensity) & (v >= F.col("__p")) & (v >= F.col("__q"))
    own = own.withColumn("__apex", F.coalesce(apex, F.lit(False)))
    own = runs(own, [key], [F.col("pos")], (v > 0) & ~F.coalesce(F.col("__p") > 0, F.lit(False))).where(v > 0)
    facts = own.groupBy(key, "run").agg(
        (F.sum(F.col("x") * v) / F.sum(v)).alias("mz"), F.sum(v).alias("intensity"), F.count(F.lit(1)).alias("n_bins"), F.min(F.when(F.col("__apex"), F.struct("pos", "value"))).alias("__first")
    )
    top = F.greatest(F.col("__first.value"), F.lit(1000.0))
    return facts.where((F.col("n_bins") >= min_bins) & F.col("__first").isNotNull()).select(key, "mz", "intensity", (2.8 / (1 + F.log10(top / 1000))).alias("precision_ppm"), "n_bins")


def peak_quality(profile: DataFrame, key: str, sigma: float) -> DataFrame:
    """(key, fwhm, apex_rt, apex_intensity, signal_to_noise, smoothness) from raw values and their smoothed form."""
    own = smooth(profile, key, sigma)
    shape = fwhm(own, key, "smoothed")
    rank = F.row_number().over(W.partitionBy(key).orderBy("value", "pos"))
    own = own.withColumn("__rank", rank).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key)))
    base = F.median(F.when(F.col("__rank") <= F.floor(F.col("__n") / 4), F.col("value")))
    facts = own.join(shape.select(key, "apex_x", "fwhm"), key).groupBy(key).agg(
        F.max("fwhm").alias("fwhm"), F.max("apex_x").alias("apex_rt"), F.max(F.when(F.col("x") == F.col("apex_x"), F.col("value"))).alias("apex_intensity"), F.coalesce(base, F.lit(1.0)).alias("__base"),
        F.stddev_pop(F.col("value") - F.col("smoothed")).alias("__res"), F.stddev_pop("value").alias("__raw"),
    )
    return facts.select(
        key, "fwhm", "apex_rt", "apex_intensity", (F.col("apex_intensity") / F.greatest(F.col("__base"), F.lit(1.0))).alias("signal_to_noise"),
        (1 - F.least(F.lit(1.0), F.col("__res") / F.greatest(F.col("__raw"), F.lit(1e-10)))).alias("smoothness"),
    )


def kernel_shape(profile: DataFrame, key: str, flat: float = 0.9) -> DataFrame:
    """(key, n, fwhm, center, flat_top) of each profile of some signal.

    fwhm: from the first rising to the last falling crossing of half the maximum, an end of the profile standing in where
    it is above half; null where the two don't bound a width.  flat_top: the widest run at ``flat`` of the maximum or more."""
    w = W.partitionBy(key)
    o = w.orderBy("pos")
    v, x = F.col("value"), F.col("x")
    own = profile.withColumn("__max", F.max("value").over(w)).where("__max > 0")
    half, top = F.col("__max") / 2, F.col("__max") * flat
    own = own.withColumns({"__v1": F.lead("value").over(o), "__x1": F.lead("x").over(o), "__v0": F.lag("value").over(o)})
    cross = x + (half - v) / F.nullif(F.col("__v1") - v, F.lit(0.0)) * (F.col("__x1") - x)
    up, down = (v < half) & (F.col("__v1") >= half), (v >= half) & (F.col("__v1") < half)
    own = own.withColumns({"__up": F.when(up, cross), "__down": F.when(down, cross), "__first": F.col("__v0").isNull() & (v >= half), "__last": F.col("__v1").isNull() & (v >= half)})
    level = runs(own.withColumn("__is", v >= top), [key], [F.col("pos")], (v >= top) & ~F.coalesce(F.col("__v0") >= top, F.lit(False)), "__run")
    flats = level.where("__is").groupBy(key, "__run").agg((F.max("x") - F.min("x")).alias("f")).groupBy(key).agg(F.max("f").alias("flat_top"))
    n = F.count(F.lit(1))
    facts = own.groupBy(key).agg(
        n.alias("n"), F.coalesce(F.min("__up"), F.max(F.when(F.col("__first"), x))).alias("__l"), F.coalesce(F.max("__down"), F.max(F.when(F.col("__last"), x))).alias("__r"), (F.sum(x * v) / F.sum(v)).alias("center")
    )
    width = F.when(F.col("__r") > F.col("__l"), F.col("__r") - F.col("__l"))
    return facts.join(flats, key, "left").select(key, "n", width.alias("fwhm"), "center", F.when(F.col("n") >= 3, F.coalesce("flat_top", F.lit(0.0))).otherwise(0.0).alias("flat_top"))


def learn_kernel(shapes: DataFrame, expected: float, least: int = 3) -> DataFrame:
    """One row (fwhm, sigma, offset, fwhm_std, offset_std, n_profiles, kernel_type, flat_top_width) from ``kernel_shape`` rows.

    Medians, and interquartile ranges over 1.35; a trapezoid if over 30 % of profiles have a flat top whose median is over
    a fifth of the width.  Raises ValueError below three profiles with a width."""
    own = shapes.where(F.col("n") >= least)
    if own.where("fwhm > 0").limit(3).count() < 3:
        raise ValueError("fewer than 3 valid profiles")
    wide, off, flat = F.when(F.col("fwhm") > 0, F.col("fwhm")), F.col("center") - expected, F.when(F.col("flat_top") > 0, F.col("flat_top"))
    (width,), (offset,), (flat_width,) = quantiles(own, wide, [0.5]), quantiles(own, off, [0.5]), quantiles(own, flat, [0.5])
    spread = lambda c: (lambda q: (q[1] - q[0]) / 1.35)(quantiles(own, c, [0.25, 0.75]))
    facts = own.agg(F.lit(width).alias("fwhm"), F.lit(offset).alias("offset"), F.lit(spread(wide)).alias("fwhm_std"), F.lit(spread(off)).alias("offset_std"), F.count(wide).alias("n_profiles"), F.count(flat).alias("__n"))
    trapezoid = (F.col("__n") > F.col("n_profiles") * 0.3) & (F.coalesce(F.lit(flat_width).cast("double"), F.lit(0.0)) > F.col("fwhm") * 0.2)
    return facts.select(
        "fwhm", (F.col("fwhm") / FWHM_SIGMA).alias("sigma"), "offset", "fwhm_std", "offset_std", "n_profiles", F.when(trapezoid, "trapezoid").otherwise("gaussian").alias("kernel_type"),
        F.when(trapezoid, F.lit(flat_width).cast("double")).otherwise(0.0).alias("flat_top_width"),
    )
