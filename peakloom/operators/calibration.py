"""Mass recalibration and retention-time calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import PROTON
from ..functions.mass import correct_mz, ppm_error
from .joins import tolerance_join
from .windows import quantiles, shared_checkpoints, weighted_quantiles


def mad_inliers(rows: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose robust z-score is under ``threshold``; all of them if the spread is under 1e-6."""
    (center,) = quantiles(rows, value, [0.5])
    apart = F.abs(F.col(value) - F.lit(center).cast("double"))
    (spread,) = quantiles(rows, apart, [0.5])
    if spread is None or spread < 1e-6:
        return rows.where(F.col(value).isNotNull())
    return rows.where(apart / (1.4826 * spread) < threshold)


def bin_count(n: int) -> int:
    """Retention bins for n observations: n // 100 within 5 to 100, fewer while a bin would have under 50."""
    bins = max(5, min(100, n // 100))
    while bins > 5 and n / bins < 50:
        bins -= 1
    return bins


def rt_bin(rt: Column, low: float, high: float, bins: int) -> Column:
    if high - low < 1e-6:
        return F.lit(0)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((rt - low) / (high - low) * bins))).cast("int")


def fill_bins(bins: DataFrame) -> DataFrame:
    """(bin, correction) with nulls filled: lines between known bins, the nearest known value beyond them, 0 without any."""
    o = W.orderBy("bin")  # over the bins of one calibration: a hundred rows at most
    before, after = o.rowsBetween(W.unboundedPreceding, 0), o.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("correction").isNotNull(), F.col("bin"))
    own = bins.withColumns({"b0": F.last(known, True).over(before), "b1": F.first(known, True).over(after), "v0": F.last("correction", True).over(before), "v1": F.first("correction", True).over(after)})
    part = (F.col("bin") - F.col("b0")) / F.nullif(F.col("b1") - F.col("b0"), F.lit(0))
    line = F.when(F.col("b0") == F.col("b1"), F.col("v0")).otherwise((1 - part) * F.col("v0") + part * F.col("v1"))
    return own.select("bin", F.coalesce(line, "v0", "v1", F.lit(0.0)).alias("correction"), *[c for c in bins.columns if c not in ("bin", "correction")])


def fit_recalibration(rows: DataFrame) -> DataFrame:
    """(bin, correction, n, rt_low, rt_high, bins, tolerance) from (observed_mz, theoretical_mz, rt_sec) rows.

    Inliers by MAD; under ten of them one bin with the median of all errors; without rows ten zero bins over an hour."""
    spark = rows.sparkSession
    own = rows.withColumn("ppm", ppm_error(F.col("observed_mz"), F.col("theoretical_mz")))
    inliers = mad_inliers(own, "ppm")
    facts = inliers.agg(F.count(F.lit(1)), F.min("rt_sec"), F.max("rt_sec")).head()
    n, low, high = facts[0], facts[1], facts[2]
    if n < 10:
        all_rows = (*own.agg(F.count(F.lit(1)), F.stddev_pop("ppm")).head(), *quantiles(own, "ppm", [0.5]))
        if not all_rows[0]:
            return spark.range(10).select(F.col("id").cast("int").alias("bin"), F.lit(0.0).alias("correction"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("rt_low"), F.lit(3600.0).alias("rt_high"), F.lit(10).alias("bins"), F.lit(20.0).alias("tolerance"))
        return own.limit(1).select(F.lit(0).alias("bin"), F.lit(float(all_rows[2])).alias("correction"), F.lit(all_rows[0]).cast("long").alias("n"), F.lit(0.0).alias("rt_low"), F.lit(0.0).alias("rt_high"), F.lit(1).alias("bins"), F.lit(max(10.0, 2 * float(all_rows[1]))).alias("tolerance"))
    bins = bin_count(n)
    medians = inliers.groupBy(rt_bin(F.col("rt_sec"), low, high, bins).alias("bin")).agg(F.median("ppm").alias("correction"), F.count(F.lit(1)).alias("n"))
    table = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(medians, "bin", "left").fillna(0, ["n"])
    table = fill_bins(table).withColumns({"rt_low": F.lit(float(low)), "rt_high": F.lit(float(high)), "bins": F.lit(bins)})
    after = quantiles(apply_recalibration(inliers, table, "observed_mz"), F.abs(ppm_error(F.col("corrected_mz"), F.col("theoretical_mz"))), [0.95])[0]
    return table.withColumn("tolerance", F.lit(max(5.0, after + 2)))


def apply_recalibration(rows: DataFrame, table: DataFrame, mz: str = "mz") -> DataFrame:
    """Adds corrected_mz by the bin of rt_sec; the table has a hundred rows at most and is broadcast."""
    own = table.select("bin", "correction", "rt_low", "rt_high", "bins")
    span = F.col("__high") - F.col("__low")
    first = own.agg(F.max("rt_low").alias("__low"), F.max("rt_high").alias("__high"), F.max("bins").alias("__bins"))
    at = F.when(span < 1e-6, 0).otherwise(F.least(F.col("__bins") - 1, F.greatest(F.lit(0), F.floor((F.col("rt_sec") - F.col("__low")) / F.nullif(span, F.lit(0.0)) * F.col("__bins")).cast("int"))))
    dealt = rows.join(F.broadcast(first)).withColumn("__at", at.cast("int"))
    out = dealt.join(F.broadcast(own.select(F.col("bin").alias("__at"), F.col("correction").alias("__c"))), "__at")
    return out.withColumn("corrected_mz", correct_mz(F.col(mz), F.col("__c"))).drop("__low", "__high", "__bins", "__at", "__c")


def presearch_errors(precursors: DataFrame, least: int = 100, ladder: tuple[float, ...] = (50.0, 30.0, 20.0, 10.0), signed: bool = False) -> DataFrame:
    """One row (median_ppm, std_ppm, recommended_tolerance, n_pairs, tolerance_used) from masses seen at unlike charges.

    precursors: id, mz, charge.  The widest tolerance of the ladder with ``least`` pairs is used, else the last; pairs run
    from the lower mass (``signed``: from the lower charge) and errors are relative to the median mass.

    Precursors of one charge and mass have the same pairs, so pairs are made between such classes, each standing for the
    product of their sizes; the errors of the tolerance used are checkpointed, as all that follows reads them."""
    shared_checkpoints(precursors.sparkSession)
    every = precursors.select("id", "charge", (F.col("mz") * F.col("charge") - F.col("charge") * PROTON).alias("mass"))
    (median,) = quantiles(every, "mass", [0.5])
    # a pair of equal masses counts from its lower id, and a missing id has none
    own = every.where("mass IS NOT NULL AND charge IS NOT NULL").groupBy("charge", "mass").agg(F.count(F.lit(1)).alias("size"), F.count("id").alias("named")).checkpoint()
    other = own.toDF("charge2", "mass2", "size2", "named2")
    for tolerance in ladder:
        pairs = tolerance_join(own, other, tolerance, "mass", "mass2", F.col("charge") != F.col("charge2"))
        pairs = pairs.where((F.col("mass2") > F.col("mass")) | ((F.col("mass2") == F.col("mass")) & (F.col("charge2") > F.col("charge"))))
        weight = F.when(F.col("mass2") > F.col("mass"), F.col("size") * F.col("size2")).otherwise(F.col("named") * F.col("named2"))
        side = F.when(F.col("charge2") > F.col("charge"), 1).otherwise(-1) if signed else F.lit(1)
        pairs = pairs.select(((F.col("mass2") - F.col("mass")) * side / median * 1e6).alias("e"), weight.alias("w")).where("w > 0").checkpoint()
        n = pairs.agg(F.coalesce(F.sum("w"), F.lit(0))).head()[0]
        if n >= least:
            break
    if not n:
        return precursors.sparkSession.createDataFrame([(0.0, 10.0, 20.0, 0, ladder[0])], "median_ppm double, std_ppm double, recommended_tolerance double, n_pairs long, tolerance_used double")
    (center,) = weighted_quantiles(pairs, "e", "w", [0.5])
    apart = pairs.withColumn("d", F.abs(F.col("e") - center))
    (spread,) = weighted_quantiles(apart, "d", "w", [0.5])
    inliers = pairs if spread < 1e-6 else apart.where(F.col("d") / (1.4826 * spread) < 3.0).drop("d")
    kept = inliers.agg(F.coalesce(F.sum("w"), F.lit(0))).head()[0]
    errors = (inliers if kept > 10 else pairs).withColumn("a", F.abs("e"))
    (center,), (wide,) = weighted_quantiles(errors, "e", "w", [0.5]), weighted_quantiles(errors, "a", "w", [0.95])
    w = F.col("w")
    mean = errors.agg(F.sum(F.col("e") * w) / F.sum(w)).head()[0]
    std = F.sqrt(F.sum((F.col("e") - mean) * (F.col("e") - mean) * w) / F.sum(w))
    return errors.agg(F.lit(center).alias("median_ppm"), std.alias("std_ppm"), F.lit(max(10.0, wide + 5)).alias("recommended_tolerance"), F.lit(n).cast("long").alias("n_pairs"), F.lit(tolerance).alias("tolerance_used"))


def recalibration_statistics(rows: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the calibration's bins and range, its tolerance, and the inliers' median and spread of errors before and
    after it.  rows: observed_mz, theoretical_mz, rt_sec; table: ``fit_recalibration``."""
    own = mad_inliers(rows.withColumn("ppm", ppm_error(F.col("observed_mz"), F.col("theoretical_mz"))), "ppm")
    after = apply_recalibration(own, table, "observed_mz").withColumn("after", ppm_error(F.col("corrected_mz"), F.col("theoretical_mz")))
    facts = table.agg(F.max("bins").alias("n_bins"), F.max("tolerance").alias("recommended_tolerance"), F.max("rt_low").alias("rt_min"), F.max("rt_high").alias("rt_max"))
    (m0,), (m1,) = quantiles(own, "ppm", [0.5]), quantiles(after, "after", [0.5])
    spread = after.agg(F.lit(m0).alias("median_ppm_before"), F.stddev_pop("ppm").alias("std_ppm_before"), F.lit(m1).alias("median_ppm_after"), F.stddev_pop("after").alias("std_ppm_after"))
    return facts.join(F.broadcast(spread))


# Retention time: pairs (run_id, irt, rt_sec); every step is a window inside one run.

def merged(pairs: DataFrame, gap: float = 1e-4) -> DataFrame:
    """(run_id, irt, rt_sec): runs of irt values whose neighbours are at most ``gap`` apart become their means."""
    o = W.partitionBy("run_id").orderBy("irt", "rt_sec")
    own = pairs.withColumn("__g", F.sum(F.when(F.coalesce(F.col("irt") - F.lag("irt").over(o) <= gap, F.lit(False)), 0).otherwise(1)).over(o.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy("run_id", "__g").agg(F.avg("irt").alias("irt"), F.avg("rt_sec").alias("rt_sec")).drop("__g")


def line(pairs: DataFrame) -> DataFrame:
    """(run_id, slope, intercept): least squares; no spread in irt: slope 0 and the mean."""
    return pairs.groupBy("run_id").agg(F.coalesce(F.regr_slope("rt_sec", "irt"), F.lit(0.0)).alias("slope"), F.avg("rt_sec").alias("my"), F.avg("irt").alias("mx")).select("run_id", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def robust_pairs(pairs: DataFrame, mads: float = 3.5) -> DataFrame:
    """Merged pairs whose residual from the line is at most ``mads`` median absolute residuals (plus 1e-12), then only those
    whose retention time exceeds all before."""
    own = merged(pairs)
    own = own.join(line(own), "run_id").withColumn("__e", F.col("rt_sec") - F.col("slope") * F.col("irt") - F.col("intercept"))
    w = W.partitionBy("run_id")
    own = own.withColumn("__d", F.abs(F.col("__e") - F.median("__e").over(w))).withColumn("__mad", F.median("__d").over(w) + 1e-12)
    own = own.where(F.abs("__e") <= mads * F.col("__mad"))
    top = F.max("rt_sec").over(w.orderBy("irt").rowsBetween(W.unboundedPreceding, -1))
    return own.withColumn("__top", top).where(F.col("__top").isNull() | (F.col("rt_sec") > F.col("__top"))).select("run_id", "irt", "rt_sec")


def pchip_segments(knots: DataFrame) -> DataFrame:
    """(run_id, x0, x1, y0, y1, m0, m1): monotone cubic segments between knots, with Fritsch-Carlson slopes."""
    o = W.partitionBy("run_id").orderBy("irt")
    own = knots.withColumns({"h": F.lead("irt").over(o) - F.col("irt"), "d": (F.lead("rt_sec").over(o) - F.col("rt_sec")) / (F.lead("irt").over(o) - F.col("irt"))})
    own = own.withColumns({"hp": F.lag("h").over(o), "dp": F.lag("d").over(o), "h2": F.lead("h").over(o), "d2": F.lead("d").over(o), "hpp": F.lag("h", 2).over(o), "dpp": F.lag("d", 2).over(o)})
    h, d, hp, dp = (F.col(c) for c in ("h", "d", "hp", "dp"))
    w1, w2 = 2 * h + hp, h + 2 * hp
    inner = F.when(d * dp > 0, (w1 + w2) / (w1 / F.nullif(dp, F.lit(0.0)) + w2 / F.nullif(d, F.lit(0.0)))).otherwise(0.0)

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / F.nullif(h0 + h1, F.lit(0.0))
        return F.when(d1.isNull(), d0).when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)

    slope = F.when(dp.isNull(), end(h, F.col("h2"), d, F.col("d2"))).when(d.isNull(), end(hp, F.col("hpp"), dp, F.col("dpp"))).otherwise(inner)
    own = own.withColumn("m", F.coalesce(slope, F.lit(0.0)))
    return own.select("run_id", F.col("irt").alias("x0"), F.lead("irt").over(o).alias("x1"), F.col("rt_sec").alias("y0"), F.lead("rt_sec").over(o).alias("y1"), F.col("m").alias("m0"), F.lead("m").over(o).alias("m1"), (F.row_number().over(o) - 1).alias("k")).where("x1 IS NOT NULL")


def hermite(x: Column) -> Column:
    h = F.col("x1") - F.col("x0")
    t = (x - F.col("x0")) / h
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * F.col("y0") + (t3 - 2 * t2 + t) * h * F.col("m0") + (3 * t2 - 2 * t3) * F.col("y1") + (t3 - t2) * h * F.col("m1")


def fit_rt(pairs: DataFrame) -> DataFrame:
    """A model per run, one row (run_id, n, t0, low_slope, high_slope, segments array).

    t0 (from four knots on) is the least time that the early secants point to; tails go on at the median of the eight
    secants at either end, at least 1e-12."""
    knots = robust_pairs(pairs)
    o = W.partitionBy("run_id").orderBy("irt")
    seg = pchip_segments(knots)
    secant = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    size = knots.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("irt", "rt_sec")).alias("first"))
    k0 = F.greatest(F.lit(3), F.least(F.lit(12), F.floor(F.col("n") * 0.05).cast("int")))
    own = seg.join(size, "run_id").withColumn("s", secant)
    facts = own.groupBy("run_id").agg(
        F.median(F.when(F.col("k") < k0, F.col("s"))).alias("early"), F.greatest(F.median(F.when(F.col("k") < 8, F.col("s"))), F.lit(1e-12)).alias("low_slope"),
        F.greatest(F.median(F.when(F.col("k") >= F.col("n") - 9, F.col("s"))), F.lit(1e-12)).alias("high_slope"),
        F.array_sort(F.collect_list(F.struct("x0", "x1", "y0", "y1", "m0", "m1"))).alias("segments"),
    )
    ranked = knots.withColumn("k", F.row_number().over(o) - 1).join(size.select("run_id", "n"), "run_id").join(facts.select("run_id", "early"), "run_id", "left")
    t0 = ranked.where(F.col("k") <= k0).groupBy("run_id").agg(F.greatest(F.lit(0.0), F.median(F.col("rt_sec") - F.col("early") * F.col("irt"))).alias("t0"))
    out = size.join(facts, "run_id", "left").join(t0, "run_id", "left")
    return out.select("run_id", "n", F.when(F.col("n") >= 4, F.col("t0")).otherwise(0.0).alias("t0"), "first", "low_slope", "high_slope", "segments")


def predict_rt(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``predicted`` to (run_id, irt) rows: cubic inside the knots, straight outside, the one time of a single knot,
    NaN for a run without a model."""
    found = rows.join(model.select("run_id", "first", "low_slope", "high_slope", "segments"), "run_id", "left")
    x = F.col("irt")
    at = F.element_at(F.filter("segments", lambda s: (s["x0"] <= x) & (x <= s["x1"])), 1)
    found = found.withColumn("__s", F.when(F.size(F.filter("segments", lambda s: (s["x0"] <= x) & (x <= s["x1"]))) > 0, at))
    lo, hi = F.element_at("segments", 1), F.element_at("segments", -1)
    inside = found.withColumns({c: F.col(f"__s.{c}") for c in ("x0", "x1", "y0", "y1", "m0", "m1")})
    value = F.when(F.col("first").isNull(), float("nan")).when(F.col("segments").isNull(), F.col("first.rt_sec")).when(F.col("__s").isNotNull(), hermite(x)).when(x < lo["x0"], lo["y0"] + F.col("low_slope") * (x - lo["x0"])).otherwise(hi["y1"] + F.col("high_slope") * (x - hi["x1"]))
    return inside.withColumn("predicted", value).select(*rows.columns, "predicted")
