"""The tolerance (band) join and its match policies.

A ppm window is narrow in log space, so m/z is binned by ln(m) with bins as wide as a whole window: a target touches two
bins at most, and the band join becomes an equi-join on the bin with the exact window re-checked.  Catalyst plans it as a
hash or sort-merge join, adaptive execution splits a crowded bin, and no nested loop is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A policy's window keeps one row for each target.
POLICIES = ("nearest", "leftmost", "neighbor", "most_intense", "best_ratio", "all")


def _bin(mz: Column, width: float) -> Column:
    return F.floor(F.ln(mz) / width).cast("long")


def tolerance_join(
    targets: DataFrame, peaks: DataFrame, tolerance: float, target_mz: str = "target_mz", mz: str = "mz", where: Column | None = None, how: str = "inner", open_top: bool = False, unit: str = "ppm"
) -> DataFrame:
    """All pairs with target - tol <= mz <= target + tol (``open_top``: mz < target + tol).

    ``unit``: "ppm", tol = target * tolerance / 1e6, or "Da", tol = tolerance.  Columns of both sides must differ in name.
    ``where`` is a further condition of a pair; ``how="left"`` keeps targets without a pair, nulls in any column
    included.  Targets of no or negative m/z match nothing."""
    if how not in ("inner", "left") or unit not in ("ppm", "Da"):
        raise ValueError(f"how is 'inner' or 'left', unit 'ppm' or 'Da'; not {how!r}, {unit!r}")
    t = F.col(target_mz)
    if unit == "ppm":
        width = math.log1p(tolerance / 1e6) - math.log1p(-tolerance / 1e6) + 1e-11  # more than a window, so two bins at most
        tol, bin_of = t * tolerance / 1e6, lambda x: _bin(x, width)
        low, high = (t - tol) * (1 - 1e-12), (t + tol) * (1 + 1e-12)
    else:
        tol, bin_of = F.lit(float(tolerance)), lambda x: F.floor(x / (2.000001 * tolerance)).cast("long")
        low, high = F.greatest(t - tol, F.lit(1e-12)), t + tol
    bins = F.when(t > 0, F.array_distinct(F.array(bin_of(low), bin_of(high)))).otherwise(F.array().cast("array<bigint>"))
    low, high = t - tol, t + tol
    if how == "left":  # a row without any bin still has one place, which no peak is dealt to
        bins = F.when(F.size(bins) > 0, bins).otherwise(F.array(F.lit(None).cast("bigint")))
        targets = targets.withColumn("__row", F.monotonically_increasing_id())
    dealt = targets.withColumn("__bin", F.explode(bins))
    # sizes of files tell little of rows in memory: a broadcast chosen by them fills the driver
    own = peaks.where(F.col(mz) > 0).withColumn("__peak_bin", bin_of(F.col(mz))).hint("merge")
    inside = (F.col(mz) >= low) & ((F.col(mz) < high) if open_top else (F.col(mz) <= high))
    condition = (F.col("__bin") == F.col("__peak_bin")) & inside
    pairs = dealt.join(own, condition if where is None else condition & where).drop("__bin", "__peak_bin")
    if how == "inner":
        return pairs
    # one evaluation of the pairs: each place of a target keeps its row, and of a target's unmatched places all go but one
    both = dealt.join(own.withColumn("__hit", F.lit(True)), condition if where is None else condition & where, "left")
    of_target = W.partitionBy("__row")
    both = both.withColumns({"__any": F.max("__hit").over(of_target), "__first": F.row_number().over(of_target.orderBy("__bin"))})
    keep = F.col("__hit").isNotNull() | (F.col("__any").isNull() & (F.col("__first") == 1))
    return both.where(keep).drop("__bin", "__peak_bin", "__row", "__hit", "__any", "__first")


def window_totals(targets: DataFrame, peaks: DataFrame, ppm: float, totals: list[str], target_mz: str = "target_mz", mz: str = "mz") -> DataFrame:
    """Targets with the sums of ``totals`` over the peaks in their windows, without the pairs; targets without a peak go.

    The window is that of ``tolerance_join``.  A window is two edges: the sum up to the upper one less the sum before the
    lower one, where running sums start anew in every bin.  So rows grow with targets and peaks, not with their pairs.
    Equal m/z of targets share one window, so that crowded ones meet only in the last join, which adaptive execution splits.
    ``totals`` are whole numbers of 0 or more, not all of them 0 in a row.  Rows of null, NaN, no or negative m/z match
    nothing."""
    width = 2 * math.log1p(ppm / 1e6)
    t = F.col("__target")
    tol = t * ppm / 1e6
    edge = lambda bin_of, at, kind, sign: F.struct(bin_of.alias("__bin"), at.alias("__at"), F.lit(kind).alias("__kind"), F.lit(sign).alias("__sign"))
    first, last = _bin(t - tol, width), _bin(t + tol, width)
    both = [edge(first, t - tol, 0, -1), edge(last, t + tol, 2, 1)]
    # A window over several bins adds the whole of each bin but its last one.
    whole = F.transform(F.sequence(first, last - 1), lambda b: edge(b, F.lit(float("inf")), 2, 1))
    edges = F.when(first == last, F.array(*both)).otherwise(F.concat(F.array(*both), whole))
    places = targets.select(F.col(target_mz).cast("double").alias("__target")).where((t > 0) & ~F.isnan(t)).distinct()
    dealt = places.select("__target", F.explode(edges).alias("__edge")).select("__edge.*", "__target", *[F.lit(0).cast("long").alias(c) for c in totals])
    m = F.col(mz)
    # One condition that names m once: Catalyst moves it below the peaks' own expressions and would repeat them for each name.
    own = peaks.where(F.ln(m) < F.lit(float("inf"))).select(
        _bin(m, width).alias("__bin"), m.cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).alias("__sign"), F.lit(None).cast("double").alias("__target"), *[F.col(c).cast("long").alias(c) for c in totals]
    )
    running = W.partitionBy("__bin").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    summed = own.unionByName(dealt).withColumns({c: F.sum(c).over(running) * F.col("__sign") for c in totals}).where("__sign <> 0")
    found = summed.groupBy("__target").agg(*[F.sum(c).alias(c) for c in totals]).where(" OR ".join(f"`{c}` > 0" for c in totals))
    return targets.join(found, F.col(target_mz).cast("double") == t).drop("__target")


def _collapsed(peaks: DataFrame, by: list[str], order: Column, last: bool = False) -> DataFrame:
    """One peak, its columns in the struct ``p``, for each value of ``by``: the first in ``order``; ``last``: in ``q`` the last too."""
    facts = F.struct(*peaks.columns)
    picked = [F.min_by(facts, order).alias("p"), *([F.max_by(facts, order).alias("q")] if last else [])]
    return peaks.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]).agg(*picked)


def _scanned(places: DataFrame, peaks: DataFrame, tolerance: float, policy: str, t: Column, mz: str, peak_id: str, intensity: str, open_top: bool, unit: str, same: dict[str, str]) -> DataFrame:
    """(columns of ``places``, p): candidates of each place, its best peak among them, without the pairs.

    Places and peaks are put in order of m/z inside bins; the peak before and after a place, or the best one so far, are
    running values.  A place is dealt to every bin that its window touches, at most three.  Bins are narrower than a window,
    so in its first bin a window is all from its lower edge on, in its last one all up to its upper edge."""
    if unit == "ppm":
        width = max(0.999 * (math.log1p(tolerance / 1e6) - math.log1p(-tolerance / 1e6)), 1e-11)
        tol, bin_of = t * tolerance / 1e6, lambda x: _bin(x, width)
    else:
        tol, bin_of = F.lit(float(tolerance)), lambda x: F.floor(x / (1.999 * tolerance)).cast("long")
    low, high = t - tol, t + tol
    names, m, i = list(same.values()), F.col(mz), F.col(peak_id)
    order = F.struct((-F.col(intensity)).alias("o"), i.alias("i")) if policy == "most_intense" else F.struct(i.alias("i"))
    own = peaks.where((m > 0) & (m < float("inf")) & (F.col(intensity) > 0 if policy == "most_intense" else F.lit(True)))
    own = own.dropna(subset=names) if names else own
    carried = ["p", "q"] if policy == "neighbor" else ["p"]  # of equal m/z below the target the highest id
    top, below = _collapsed(own, [mz, *names], order, policy == "neighbor"), carried[-1]
    keys = ["__bin", *(f"__s{k}" for k in range(len(names)))]
    rank = F.struct((-F.col(f"p.`{intensity}`")).alias("o"), F.col(f"p.`{peak_id}`").alias("i")) if policy == "most_intense" else F.lit(0)
    top = top.select(bin_of(F.col("__g0")).alias("__bin"), *[F.col(f"__g{k + 1}").alias(f"__s{k}") for k in range(len(names))], F.col("__g0").alias("__at"), F.lit(1).alias("__kind"), *carried, rank.alias("__rank"), F.lit(None).cast("struct<x:int>").alias("__place"))
    facts = F.struct(*places.columns)
    first, last = bin_of(low), bin_of(high)
    dealt = places.where((t > 0) & (t < float("inf"))).select(F.explode(F.sequence(first, last)).alias("__bin"), *[F.col(c).alias(f"__s{k}") for k, c in enumerate(same)], facts.alias("__place"), low.alias("__low"), high.alias("__high"), t.alias("__t"), first.alias("__first"), last.alias("__last"))
    up_to = lambda at, kind: dealt.withColumns({"__at": at, "__kind": F.lit(kind)})
    if policy == "most_intense":
        from_low = F.col("__bin") == F.col("__first")
        at = F.when(from_low, F.col("__low")).when(F.col("__bin") == F.col("__last"), F.col("__high")).otherwise(F.lit(float("inf")))
        dealt = up_to(at, 0).withColumn("__kind", F.when(from_low | F.lit(open_top), 0).otherwise(2))
    else:
        dealt = up_to(F.col("__low") if policy == "leftmost" else F.col("__t"), 0)
    nothing = dict(top.dtypes)
    dealt = dealt.select(*keys, "__at", "__kind", *[F.lit(None).cast(nothing[c]).alias(c) for c in (*carried, "__rank")], "__place", "__low", "__high", "__first")
    top = top.select(*keys, "__at", "__kind", *carried, "__rank", F.lit(None).cast(dict(dealt.dtypes)["__place"]).alias("__place"), *[F.lit(None).cast(dict(dealt.dtypes)[c]).alias(c) for c in ("__low", "__high", "__first")])
    both = top.unionByName(dealt)
    rising = W.partitionBy(*keys).orderBy(F.col("__at"), F.col("__kind")).rowsBetween(W.unboundedPreceding, 0)
    falling = W.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__kind").desc()).rowsBetween(W.unboundedPreceding, 0)
    if policy == "most_intense":
        both = both.withColumns({"__a": F.min_by("p", "__rank").over(rising), "__b": F.min_by("p", "__rank").over(falling)})
        found = F.when(F.col("__bin") == F.col("__first"), F.array("__b")).otherwise(F.array("__a"))
    elif policy == "leftmost":
        both, found = both.withColumn("__b", F.last("p", True).over(falling)), F.array("__b")
    else:
        both = both.withColumns({"__a": F.last(below, True).over(rising), "__b": F.last("p", True).over(falling)})
        found = F.array("__a", "__b")
    out = both.where("__place IS NOT NULL").select("__place", "__low", "__high", F.explode(found).alias("p"))
    at = F.col(f"p.`{mz}`")
    return out.where((at >= F.col("__low")) & ((at < F.col("__high")) if open_top else (at <= F.col("__high")))).select("__place.*", "p")


#: Policies whose best peak in a window is a running value over m/z.
SCANNED = ("nearest", "leftmost", "neighbor", "most_intense")


def match(
    targets: DataFrame, peaks: DataFrame, tolerance: float, policy: str, key: list[str], target_mz: str = "target_mz", mz: str = "mz", peak_id: str = "peak_id",
    intensity: str = "intensity", where: Column | None = None, open_top: bool = False, unit: str = "ppm", ratio_to: str = "target_intensity", most_ratio: float = 1.5,
    reads: tuple[list[str], list[str]] | None = None, same: dict[str, str] | None = None,
) -> DataFrame:
    """One peak for each target (by ``key``), chosen by ``policy``; targets without a peak are left out.

    nearest: least absolute difference, then lowest id.  leftmost: lowest m/z, then lowest id.  neighbor: least absolute
    ppm; of equal ones the lower m/z; of equal m/z below the target the highest id, else the lowest.  most_intense: highest
    intensity above 0, then lowest id.  best_ratio: highest ratio of the peak's intensity to the target's column
    ``ratio_to``, above 0 and up to ``most_ratio``, then lowest m/z, then lowest id; its windows are open at the top.
    all: every pair.

    ``same``: target columns and the peak columns that equal them.  ``where`` is a further condition of a pair, and
    ``reads`` names the target's and the peak's columns in it.  Targets alike in all that decides are matched once, and of
    peaks alike only the first takes part.  Without ``where`` no pair is made either, but for best_ratio."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {POLICIES}")
    same, open_top = same or {}, open_top or policy == "best_ratio"
    t, m, i = F.col(target_mz), F.col(mz), F.col(peak_id)
    ratio = F.col(intensity) / F.nullif(F.col(ratio_to), F.lit(0)) if policy == "best_ratio" else None
    least = {
        "nearest": [F.abs(m - t), i],
        "leftmost": [m, i],
        "neighbor": [F.abs((m - t) / t * 1e6), m, F.when(m < t, -i).otherwise(i)],
        "most_intense": [-F.col(intensity), i],
        "best_ratio": [-ratio, m, i] if ratio is not None else [],
        "all": [],
    }[policy]
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(least)]) if least else None
    on = list(dict.fromkeys([target_mz, *same, *([ratio_to] if policy == "best_ratio" else []), *(reads[0] if reads else [])]))
    if where is None and policy in SCANNED and tolerance > 0:
        best = _scanned(targets.select(*on).distinct(), peaks, tolerance, policy, t, mz, peak_id, intensity, open_top, unit, same)
        best = best.select(*on, "p.*")
    else:
        collapse = policy not in ("all", "neighbor") and (where is None or reads is not None)
        for a, b in same.items():
            where = (F.col(a) == F.col(b)) if where is None else where & (F.col(a) == F.col(b))
        few, own = targets, peaks
        if collapse:
            by = list(dict.fromkeys([mz, *same.values(), *([intensity] if policy == "best_ratio" else []), *(reads[1] if reads else [])]))
            first = F.struct((-F.col(intensity)).alias("o"), i.alias("i")) if policy == "most_intense" else F.struct(i.alias("i"))
            few, own = targets.select(*on).distinct(), _collapsed(peaks.where(F.col(intensity) > 0) if policy in ("most_intense", "best_ratio") else peaks, by, first).select("p.*")
        pairs = tolerance_join(few, own, tolerance, target_mz, mz, where, open_top=open_top, unit=unit)
        if policy == "all":
            return pairs
        if policy == "most_intense":
            pairs = pairs.where(F.col(intensity) > 0)
        if policy == "best_ratio":
            pairs = pairs.where((ratio > 0) & (ratio <= most_ratio))
        if not collapse:
            return pairs.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg(F.min_by(F.struct(*pairs.columns), order).alias("__best")).select("__best.*")
        best = pairs
    best = best.groupBy(*[F.col(c).alias(f"__on{k}") for k, c in enumerate(on)]).agg(F.min_by(F.struct(*peaks.columns), order).alias("__p"))
    back = [F.col(c).eqNullSafe(F.col(f"__on{k}")) for k, c in enumerate(on)]
    got = targets.join(best.hint("merge"), back).select(*targets.columns, "__p.*")
    return got.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg(F.min_by(F.struct(*got.columns), order).alias("__best")).select("__best.*")


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, width: float) -> DataFrame:
    """Pairs with start <= point <= stop, by an equi-join on buckets of ``width``."""
    own = points.withColumn("__bucket", F.floor(F.col(point) / width).cast("long"))
    dealt = intervals.withColumn("__span", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(stop) / width).cast("long"))))
    return own.join(dealt, (F.col("__bucket") == F.col("__span")) & (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(stop))).drop("__bucket", "__span")
