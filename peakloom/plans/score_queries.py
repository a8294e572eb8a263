"""Queries over scores, calibrations and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import calibration, fdr, profiles, psm, rescoring
from .views import Registry

R = Registry()

_FDR = """t AS (SELECT psm_id, score, row_number() OVER (ORDER BY score DESC, psm_id) AS rk FROM {0} WHERE NOT is_decoy), u AS (SELECT score, sum(count(*) FILTER (is_decoy)) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS d FROM {0} GROUP BY score),
  f AS (SELECT psm_id, t.score, rk, least(1, (d + 1) / rk) AS fdr FROM t JOIN u ON t.score = u.score), q AS (SELECT psm_id, score, fdr, min(fdr) OVER (ORDER BY rk DESC) AS q_value FROM f)"""


@R.add("fdr_qvalue", _FDR.format("v_psms") + ":: SELECT psm_id, score, fdr, q_value FROM q", "fdr q_value")
def _(v, spark):
    return fdr.q_values(v("v_psms")).select("psm_id", "score", "fdr", "q_value")


_PI0 = "p AS (SELECT CASE WHEN count(*) FILTER (is_decoy) = 0 OR count(*) FILTER (NOT is_decoy) = 0 THEN 1 ELSE least(1, 2 * count(*) FILTER (is_decoy) / count(*) FILTER (NOT is_decoy)) END AS pi0 FROM v_psms WHERE score <= (SELECT median(score) FROM v_psms))"


@R.add("fdr_pi0", _PI0 + ":: SELECT CAST(pi0 AS DOUBLE) AS pi0 FROM p", "pi0")
def _(v, spark):
    return fdr.pi0(v("v_psms"))


@R.add("fdr_qvalue_pi0", _FDR.format("v_psms") + f", {_PI0}:: SELECT psm_id, fdr, least(1, q_value * pi0) AS q_value FROM q, p", "fdr q_value")
def _(v, spark):
    return fdr.q_values(v("v_psms"), with_pi0=True).select("psm_id", "fdr", "q_value")


@R.add("fdr_picked", "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, psm_id) AS k FROM v_psms) WHERE k = 1), " + _FDR.format("w") + ", g AS (SELECT group_id, fdr, q_value FROM q JOIN w USING (psm_id)):: SELECT psm_id, is_decoy, coalesce(fdr, 1) AS fdr, coalesce(q_value, 1) AS q_value FROM v_psms LEFT JOIN g USING (group_id)", "fdr q_value")
def _(v, spark):
    return fdr.picked_fdr(v("v_psms")).select("psm_id", "is_decoy", "fdr", "q_value")


_TD = "c AS (SELECT psm_id, is_decoy, row_number() OVER (ORDER BY score DESC, psm_id) AS k, count(*) FILTER (is_decoy) OVER (ORDER BY score DESC, psm_id) AS d, count(*) FILTER (NOT is_decoy) OVER (ORDER BY score DESC, psm_id) AS t FROM v_psms), s AS (SELECT psm_id, is_decoy, least(1, min(d / greatest(t, 1)) OVER (ORDER BY k DESC)) AS q_value FROM c)"


@R.add("td_qvalue", _TD + ":: SELECT psm_id, q_value FROM s", "q_value")
def _(v, spark):
    return fdr.target_decoy_q(v("v_psms")).select("psm_id", "q_value")


_TIERED = "c AS (SELECT psm_id, tier, row_number() OVER w AS k, count(*) FILTER (is_decoy) OVER w AS d, count(*) FILTER (NOT is_decoy) OVER w AS t FROM (SELECT *, nullif(group_id % 4, 3) AS tier FROM v_psms) WHERE tier IS NOT NULL WINDOW w AS (PARTITION BY tier ORDER BY score DESC, psm_id))"


@R.add("td_qvalue_tiers", _TIERED + ":: SELECT psm_id, least(1, min(d / greatest(t, 1)) OVER (PARTITION BY tier ORDER BY k DESC)) AS q_value FROM c UNION ALL SELECT psm_id, 1 FROM v_psms WHERE group_id % 4 = 3", "q_value")
def _(v, spark):
    own = v("v_psms").withColumn("tier", F.when(F.col("group_id") % 4 != 3, F.col("group_id") % 4))
    return fdr.target_decoy_q(own, tier="tier").select("psm_id", "q_value")


@R.add("fdr_stats", _TD + ":: SELECT count(*) FILTER (NOT is_decoy) AS n_targets, count(*) FILTER (is_decoy) AS n_decoys, count(*) FILTER (NOT is_decoy AND q_value <= 0.01) AS n_1pct, count(*) FILTER (NOT is_decoy AND q_value <= 0.05) AS n_5pct, count(*) FILTER (NOT is_decoy AND q_value <= 0.1) AS n_10pct FROM s")
def _(v, spark):
    return fdr.statistics(fdr.target_decoy_q(v("v_psms")))


_PPM = "o AS (SELECT *, (observed_mz - theoretical_mz) / theoretical_mz * 1e6 AS ppm FROM v_calibration), md AS (SELECT median(ppm) AS m FROM o), sp AS (SELECT median(abs(ppm - m)) AS s FROM o, md), i AS (SELECT o.* FROM o, md, sp WHERE s < 1e-6 OR abs(ppm - m) / (1.4826 * s) < 3)"


@R.add("mad_inliers", _PPM.replace("< 3)", "< 1.2)") + ":: SELECT theoretical_mz, rt_sec, ppm FROM i", "theoretical_mz ppm", 4)
def _(v, spark):
    own = v("v_calibration").withColumn("ppm", (F.col("observed_mz") - F.col("theoretical_mz")) / F.col("theoretical_mz") * 1e6)
    return calibration.mad_inliers(own, "ppm", 1.2).select("theoretical_mz", "rt_sec", "ppm")


_N = "least(100, greatest(5, (SELECT count(*) FROM i) // 100))"
_BINS = _PPM + """, z AS (SELECT min(rt_sec) AS lo, max(rt_sec) AS hi, count(*) AS n FROM i), nb AS (SELECT max(b) AS nb FROM z, (SELECT unnest(generate_series(5, 100)) AS b) WHERE b <= least(100, greatest(5, n // 100)) AND (b = 5 OR n / b >= 50)),
  m AS (SELECT CAST(least(nb - 1, greatest(0, floor((rt_sec - lo) / (hi - lo) * nb))) AS INTEGER) AS bin, median(ppm) AS correction, count(*) AS n FROM i, z, nb GROUP BY 1)"""


@R.add("recal_bins", _BINS + ":: SELECT bin, correction, n FROM m", "correction", 4)
def _(v, spark):
    table = calibration.fit_recalibration(v("v_calibration"))
    return table.where("n > 0").select("bin", "correction", "n")


@R.add("recal_apply", _BINS + ":: SELECT peak_id, mz / (1 + correction / 1e6) AS corrected_mz FROM v_peaks, z, nb JOIN m ON m.bin = CAST(least(nb - 1, greatest(0, floor((rt_sec - lo) / (hi - lo) * nb))) AS INTEGER)", "corrected_mz", 5)
def _(v, spark):
    table = calibration.fit_recalibration(v("v_calibration"))
    return calibration.apply_recalibration(v("v_peaks"), table).select("peak_id", "corrected_mz")


@R.add("recal_statistics", _BINS + """, c AS (SELECT ppm, (observed_mz / (1 + correction / 1e6) - theoretical_mz) / theoretical_mz * 1e6 AS after FROM i, z, nb JOIN m ON m.bin = CAST(least(nb - 1, greatest(0, floor((rt_sec - lo) / (hi - lo) * nb))) AS INTEGER))
  :: SELECT (SELECT nb FROM nb) AS n_bins, greatest(5, quantile_cont(abs(after), 0.95) + 2) AS recommended_tolerance, (SELECT lo FROM z) AS rt_min, (SELECT hi FROM z) AS rt_max, median(ppm) AS median_ppm_before, stddev_pop(ppm) AS std_ppm_before, median(after) AS median_ppm_after, stddev_pop(after) AS std_ppm_after FROM c""",
    "n_bins recommended_tolerance rt_min rt_max median_ppm_before std_ppm_before median_ppm_after std_ppm_after", 4)
def _(v, spark):
    return calibration.recalibration_statistics(v("v_calibration"), calibration.fit_recalibration(v("v_calibration")))


@R.add("fill_bins", "k AS (SELECT peak_id % 97 AS bin, CASE WHEN (peak_id % 97) % 5 = 2 THEN max(intensity) END AS correction FROM v_peaks GROUP BY 1), w AS (SELECT bin, correction, last_value(correction IGNORE NULLS) OVER a AS v0, first_value(correction IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN correction IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS b0, first_value(CASE WHEN correction IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS b1 FROM k WINDOW a AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)):: SELECT bin, coalesce(CASE WHEN b0 = b1 THEN v0 ELSE (1 - (bin - b0) / (b1 - b0)) * v0 + (bin - b0) / (b1 - b0) * v1 END, v0, v1, 0) AS correction FROM w", "correction", 4)
def _(v, spark):
    bins = v("v_peaks").groupBy((F.col("peak_id") % 97).alias("bin")).agg(F.max("intensity").alias("i"))
    return calibration.fill_bins(bins.select("bin", F.when(F.col("bin") % 5 == 2, F.col("i")).alias("correction")))


@R.add("presearch_charge_error", """c AS (SELECT feature_id AS id, charge, mz * charge - charge * CAST(1.007276466622 AS DOUBLE) AS mass FROM v_features WHERE charge > 0),
  w AS (SELECT a.mass AS am, b.mass AS bm FROM c a JOIN c b ON a.charge <> b.charge AND b.mass <= a.mass + a.mass * 50.0 / 1e6 AND (b.mass > a.mass OR (b.mass = a.mass AND b.id > a.id))),
  tl AS (SELECT CAST(CASE WHEN count(*) >= 100 THEN 50 ELSE 10 END AS DOUBLE) AS tol FROM w), p AS (SELECT (bm - am) / (SELECT median(mass) FROM c) * 1e6 AS e FROM w, tl WHERE bm <= am + am * tol / 1e6),
  m AS (SELECT median(e) AS m FROM p), s AS (SELECT median(abs(e - m)) AS s FROM p, m), k AS (SELECT e FROM p, m, s WHERE s < 1e-6 OR abs(e - m) / (1.4826 * s) < 3),
  i AS (SELECT e FROM k WHERE (SELECT count(*) FROM k) > 10 UNION ALL SELECT e FROM p WHERE (SELECT count(*) FROM k) <= 10)
  :: SELECT median(e) AS median_ppm, stddev_pop(e) AS std_ppm, greatest(10, quantile_cont(abs(e), 0.95) + 5) AS recommended_tolerance, (SELECT count(*) FROM p) AS n_pairs, (SELECT tol FROM tl) AS tolerance_used FROM i""", "median_ppm std_ppm recommended_tolerance tolerance_used", 4)
def _(v, spark):
    return calibration.presearch_errors(v("v_features").where("charge > 0").select(F.col("feature_id").alias("id"), "mz", "charge"))


_MERGED = "g AS (SELECT run_id, irt, rt_sec, sum(o) OVER (PARTITION BY run_id ORDER BY irt, rt_sec ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN irt - lag(irt) OVER (PARTITION BY run_id ORDER BY irt, rt_sec) <= 1e-4 THEN 0 ELSE 1 END AS o FROM v_pairs)), mg AS (SELECT run_id, g, avg(irt) AS irt, avg(rt_sec) AS rt_sec FROM g GROUP BY run_id, g)"


@R.add("rt_dedup", _MERGED + ":: SELECT run_id, irt, rt_sec FROM mg", "irt rt_sec", 5)
def _(v, spark):
    return calibration.merged(v("v_pairs"))


@R.add("rt_ols", _MERGED + ":: SELECT run_id, regr_slope(rt_sec, irt) AS slope, avg(rt_sec) - regr_slope(rt_sec, irt) * avg(irt) AS intercept FROM mg GROUP BY run_id", "slope intercept", 5)
def _(v, spark):
    return calibration.line(calibration.merged(v("v_pairs")))


_KNOTS = _MERGED + """, ol AS (SELECT run_id, regr_slope(rt_sec, irt) AS b, avg(rt_sec) - regr_slope(rt_sec, irt) * avg(irt) AS a FROM mg GROUP BY run_id), re AS (SELECT mg.run_id, irt, rt_sec, rt_sec - b * irt - a AS e FROM mg JOIN ol USING (run_id)),
  rd AS (SELECT re.*, abs(e - m) AS d FROM re JOIN (SELECT run_id, median(e) AS m FROM re GROUP BY run_id) USING (run_id)), rk AS (SELECT rd.* FROM rd JOIN (SELECT run_id, median(d) + 1e-12 AS mad FROM rd GROUP BY run_id) USING (run_id) WHERE abs(e) <= 3.5 * mad),
  kn AS (SELECT run_id, irt, rt_sec FROM (SELECT *, max(rt_sec) OVER (PARTITION BY run_id ORDER BY irt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM rk) WHERE t IS NULL OR rt_sec > t)"""


@R.add("rt_knots", _KNOTS + ":: SELECT run_id, irt, rt_sec FROM kn", "irt rt_sec", 5)
def _(v, spark):
    return calibration.robust_pairs(v("v_pairs"))


_SEGMENTS = _KNOTS + """, s1 AS (SELECT *, lead(irt) OVER w - irt AS h, (lead(rt_sec) OVER w - rt_sec) / (lead(irt) OVER w - irt) AS d FROM kn WINDOW w AS (PARTITION BY run_id ORDER BY irt)),
  s2 AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS h2, lead(d) OVER w AS d2, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp FROM s1 WINDOW w AS (PARTITION BY run_id ORDER BY irt)),
  s3 AS (SELECT *, ((2 * h + h2) * d - h * d2) / (h + h2) AS em, ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) AS ez FROM s2),
  s4 AS (SELECT *, CASE WHEN dp IS NULL THEN CASE WHEN d2 IS NULL THEN d WHEN sign(em) <> sign(d) THEN 0 WHEN sign(d) <> sign(d2) AND abs(em) > 3 * abs(d) THEN 3 * d ELSE em END
    WHEN d IS NULL THEN CASE WHEN dpp IS NULL THEN dp WHEN sign(ez) <> sign(dp) THEN 0 WHEN sign(dp) <> sign(dpp) AND abs(ez) > 3 * abs(dp) THEN 3 * dp ELSE ez END
    WHEN d * dp > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) ELSE 0 END AS m FROM s3),
  sg AS (SELECT run_id, irt AS x0, lead(irt) OVER w AS x1, rt_sec AS y0, lead(rt_sec) OVER w AS y1, m AS m0, lead(m) OVER w AS m1, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM s4 WINDOW w AS (PARTITION BY run_id ORDER BY irt))"""


@R.add("pchip_segments", _SEGMENTS + ":: SELECT run_id, x0, x1, y0, y1, m0, m1 FROM sg WHERE x1 IS NOT NULL", "x0 x1 y0 y1 m0 m1", 4)
def _(v, spark):
    return calibration.pchip_segments(calibration.robust_pairs(v("v_pairs"))).drop("k")


@R.add("pchip_predict", _SEGMENTS + """, sl AS (SELECT run_id, greatest(median((y1 - y0) / (x1 - x0)) FILTER (k < 8), 1e-12) AS lo, greatest(median((y1 - y0) / (x1 - x0)) FILTER (k >= n - 9), 1e-12) AS hi, min(x0) AS xa, max(x1) AS xz, arg_min(y0, x0) AS ya, arg_max(y1, x1) AS yz FROM sg WHERE x1 IS NOT NULL GROUP BY run_id),
  at AS (SELECT run_id, CAST(i AS DOUBLE) * 7.3 - 60 AS irt FROM (SELECT DISTINCT run_id FROM v_pairs), (SELECT unnest(generate_series(0, 99)) AS i)),
  pr AS (SELECT at.*, sl.*, sg.x0, sg.x1, y0, y1, m0, m1, (at.irt - sg.x0) / (sg.x1 - sg.x0) AS t, sg.x1 - sg.x0 AS h, row_number() OVER (PARTITION BY at.run_id, at.irt ORDER BY sg.x0) AS r FROM at JOIN sl ON sl.run_id = at.run_id LEFT JOIN sg ON sg.run_id = at.run_id AND sg.x1 IS NOT NULL AND at.irt BETWEEN sg.x0 AND sg.x1)
  :: SELECT run_id, irt, CASE WHEN x0 IS NOT NULL THEN (2*t*t*t - 3*t*t + 1)*y0 + (t*t*t - 2*t*t + t)*h*m0 + (3*t*t - 2*t*t*t)*y1 + (t*t*t - t*t)*h*m1 WHEN irt < xa THEN ya + lo * (irt - xa) ELSE yz + hi * (irt - xz) END AS predicted FROM pr WHERE r = 1""".replace("at AS (", "pts AS (").replace("at.", "pts.").replace("FROM at JOIN", "FROM pts JOIN"), "irt predicted", 4)
def _(v, spark):
    points = v("v_pairs").select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i")).select("run_id", (F.col("i").cast("double") * 7.3 - 60).alias("irt"))
    return calibration.predict_rt(points, calibration.fit_rt(v("v_pairs")))


_T0 = """, kc AS (SELECT run_id, irt, rt_sec, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n, (lead(rt_sec) OVER w - rt_sec) / (lead(irt) OVER w - irt) AS s FROM kn WINDOW w AS (PARTITION BY run_id ORDER BY irt)),
  fa AS (SELECT run_id, max(n) AS n, median(s) FILTER (k < greatest(3, least(12, floor(n * 0.05)))) AS early, greatest(1e-12, median(s) FILTER (k < 8)) AS low_slope, greatest(1e-12, median(s) FILTER (k >= n - 9)) AS high_slope, count(s) AS n_segments FROM kc GROUP BY run_id),
  tz AS (SELECT run_id, greatest(0, median(rt_sec - early * irt)) AS t0 FROM kc JOIN fa USING (run_id) WHERE k <= greatest(3, least(12, floor(kc.n * 0.05))) GROUP BY run_id)"""


@R.add("rt_pchip_fit", _KNOTS + _T0 + ":: SELECT run_id, n, CASE WHEN n >= 4 THEN t0 ELSE 0 END AS t0, low_slope, high_slope, CAST(n_segments AS INTEGER) AS n_segments FROM fa JOIN tz USING (run_id)", "t0 low_slope high_slope", 4)
def _(v, spark):
    return calibration.fit_rt(v("v_pairs")).select("run_id", "n", "t0", "low_slope", "high_slope", F.size("segments").alias("n_segments"))


_K = [(k, math.exp(-0.5 * (k / 1.5) ** 2)) for k in range(-5, 6)]
_SMOOTH = "sm AS (SELECT *, (" + " + ".join(f"coalesce({f'lag(value, {-k})' if k < 0 else f'lead(value, {k})'} OVER w, 0) * {g!r}" for k, g in _K) + ") / (" + " + ".join(f"CASE WHEN {f'lag(value, {-k})' if k < 0 else f'lead(value, {k})'} OVER w IS NOT NULL THEN {g!r} ELSE 0 END" for k, g in _K) + ") AS smoothed FROM v_profiles WINDOW w AS (PARTITION BY vec_id ORDER BY pos))"


@R.add("gaussian_smooth", _SMOOTH + ":: SELECT vec_id, pos, smoothed FROM sm", "smoothed")
def _(v, spark):
    return profiles.smooth(v("v_profiles"), "vec_id", 1.5).select("vec_id", "pos", "smoothed")


def _fwhm_sql(source: str, value: str, out: str) -> str:
    return f"""a0 AS (SELECT *, max({value}) OVER p AS mx, count(*) OVER p AS n, lead(x) OVER o AS nx, lead({value}) OVER o AS nv, lag(x) OVER o AS px, lag({value}) OVER o AS pv FROM {source} WINDOW p AS (PARTITION BY vec_id), o AS (PARTITION BY vec_id ORDER BY pos)),
  a1 AS (SELECT *, min(CASE WHEN {value} = mx THEN pos END) OVER (PARTITION BY vec_id) AS ap FROM a0), a2 AS (SELECT *, max(CASE WHEN {value} <= mx / 2 AND pos < ap THEN pos END) OVER (PARTITION BY vec_id) AS l, min(CASE WHEN {value} <= mx / 2 AND pos > ap THEN pos END) OVER (PARTITION BY vec_id) AS r FROM a1),
  a3 AS (SELECT vec_id, max(CASE WHEN pos = ap THEN x END) AS apex_x, max(mx) AS apex, max(n) AS n, max(CASE WHEN pos = l THEN CASE WHEN abs(nv - {value}) <= 1e-10 THEN x ELSE x + (mx / 2 - {value}) / (nv - {value}) * (nx - x) END END) AS lx,
    max(CASE WHEN pos = r THEN CASE WHEN abs({value} - pv) <= 1e-10 THEN px ELSE px + (mx / 2 - pv) / ({value} - pv) * (x - px) END END) AS rx FROM a2 GROUP BY vec_id),
  {out} AS (SELECT vec_id, apex_x, apex, CASE WHEN n < 3 THEN -1 WHEN lx IS NOT NULL AND rx IS NOT NULL THEN rx - lx WHEN lx IS NOT NULL THEN 2 * (apex_x - lx) WHEN rx IS NOT NULL THEN 2 * (rx - apex_x) ELSE -1 END AS fwhm FROM a3)"""


@R.add("fwhm", _fwhm_sql("v_profiles", "value", "fw") + ":: SELECT * FROM fw", "apex_x apex fwhm")
def _(v, spark):
    return profiles.fwhm(v("v_profiles"), "vec_id")


@R.add("peak_quality", _SMOOTH + ", " + _fwhm_sql("sm", "smoothed", "fw") + """, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value, pos) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM sm),
  q AS (SELECT vec_id, max(fwhm) AS fwhm, max(apex_x) AS apex_rt, max(CASE WHEN x = apex_x THEN value END) AS apex_intensity, coalesce(median(CASE WHEN k <= n // 4 THEN value END), 1) AS b, stddev_pop(value - smoothed) AS s, stddev_pop(value) AS r FROM rk JOIN fw USING (vec_id) GROUP BY vec_id)
  :: SELECT vec_id, fwhm, apex_rt, apex_intensity, apex_intensity / greatest(b, 1) AS signal_to_noise, 1 - least(1, s / greatest(r, 1e-10)) AS smoothness FROM q""", "fwhm apex_rt apex_intensity signal_to_noise smoothness", 5)
def _(v, spark):
    return profiles.peak_quality(v("v_profiles"), "vec_id", 1.5)


@R.add("centroid", """z AS (SELECT vec_id, pos, x, CASE WHEN value < 0.05 THEN 0 ELSE value * 20000 END AS value FROM v_profiles), a AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
  b AS (SELECT *, sum(CASE WHEN value > 0 AND NOT coalesce(p > 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM a),
  c AS (SELECT vec_id, run, sum(x * value) / sum(value) AS mz, sum(value) AS intensity, count(*) AS n_bins, arg_min(value, pos) FILTER (value >= 1000 AND value >= p AND value >= q) AS top FROM b WHERE value > 0 GROUP BY vec_id, run)
  :: SELECT vec_id, mz, intensity, 2.8 / (1 + log10(greatest(top, 1000) / 1000)) AS precision_ppm, n_bins FROM c WHERE n_bins >= 3 AND top IS NOT NULL""", "mz intensity precision_ppm", 5)
def _(v, spark):
    own = v("v_profiles").withColumn("value", F.when(F.col("value") < 0.05, 0.0).otherwise(F.col("value") * 20000))
    return profiles.centroid(own, "vec_id")


_SHAPE = """k0 AS (SELECT *, max(value) OVER (PARTITION BY vec_id) AS mx, lead(value) OVER w AS v1, lead(x) OVER w AS x1, lag(value) OVER w AS v0 FROM v_profiles WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
  k1 AS (SELECT *, CASE WHEN value < mx / 2 AND v1 >= mx / 2 THEN x + (mx / 2 - value) / (v1 - value) * (x1 - x) END AS up, CASE WHEN value >= mx / 2 AND v1 < mx / 2 THEN x + (mx / 2 - value) / (v1 - value) * (x1 - x) END AS down,
    sum(CASE WHEN value >= mx * 0.9 AND NOT coalesce(v0 >= mx * 0.9, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM k0 WHERE mx > 0),
  fl AS (SELECT vec_id, max(f) AS flat_top FROM (SELECT vec_id, run, max(x) - min(x) AS f FROM k1 WHERE value >= mx * 0.9 GROUP BY vec_id, run) GROUP BY vec_id),
  k2 AS (SELECT vec_id, count(*) AS n, coalesce(min(up), max(CASE WHEN v0 IS NULL AND value >= mx / 2 THEN x END)) AS l, coalesce(max(down), max(CASE WHEN v1 IS NULL AND value >= mx / 2 THEN x END)) AS r, sum(x * value) / sum(value) AS center FROM k1 GROUP BY vec_id),
  sh AS (SELECT vec_id, n, CASE WHEN r > l THEN r - l END AS fwhm, center, coalesce(flat_top, 0) AS flat_top FROM k2 LEFT JOIN fl USING (vec_id))"""


@R.add("kernel_shape", _SHAPE + ":: SELECT * FROM sh", "fwhm center flat_top", 5)
def _(v, spark):
    return profiles.kernel_shape(v("v_profiles"), "vec_id")


@R.add("kernel_learn", _SHAPE + """, ag AS (SELECT median(fwhm) FILTER (fwhm > 0) AS fwhm, median(center - 16) AS "offset", (quantile_cont(fwhm, 0.75) - quantile_cont(fwhm, 0.25)) / 1.35 AS fwhm_std, (quantile_cont(center - 16, 0.75) - quantile_cont(center - 16, 0.25)) / 1.35 AS offset_std, count(*) FILTER (fwhm > 0) AS n_profiles, count(*) FILTER (flat_top > 0) AS nf, median(flat_top) FILTER (flat_top > 0) AS f FROM sh)
  :: SELECT fwhm, fwhm / 2.355 AS sigma, "offset", fwhm_std, offset_std, n_profiles, CASE WHEN nf > n_profiles * 0.3 AND f > fwhm * 0.2 THEN 'trapezoid' ELSE 'gaussian' END AS kernel_type, CASE WHEN nf > n_profiles * 0.3 AND f > fwhm * 0.2 THEN f ELSE 0 END AS flat_top_width FROM ag""", "fwhm sigma fwhm_std offset_std flat_top_width", 5)
def _(v, spark):
    out = profiles.learn_kernel(profiles.kernel_shape(v("v_profiles"), "vec_id"), 16.0)
    return out


def _labelled(v):
    own = v("v_profiles").groupBy("vec_id").agg(F.max("label").alias("label"), F.max("value").alias("score"))
    return own.select("vec_id", (F.col("label") % 7).alias("window"), (F.col("label") % 2 == 0).cast("int").alias("label"), "score")


@R.add("top_k_accuracy", "o AS (SELECT vec_id, max(label) % 7 AS w, CAST(max(label) % 2 = 0 AS INTEGER) AS label, max(value) AS score FROM v_profiles GROUP BY vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, label) AS k FROM o):: SELECT avg(CAST(h AS DOUBLE)) AS accuracy, count(*) AS groups FROM (SELECT w, max(label) AS h FROM r WHERE k <= 2 GROUP BY w)", "accuracy")
def _(v, spark):
    return rescoring.top_k_accuracy(_labelled(v), ["window"], k=2)


def _rescored(v):
    """Scores with a signal, as the driver's table has none: targets score higher on even ids."""
    own = psm.dda_features(v("v_dda"))
    lift = F.when(~F.col("is_decoy") & (F.col("psm_id") % 2 == 0), 6.0).otherwise(0.0)
    return own.withColumn("log_hyperscore", F.col("log_hyperscore") + lift).withColumn("delta_score", F.col("delta_score") + lift / 2)


@R.add("rf_rescore", None)
def _(v, spark):
    return rescoring.rf_rescore(_rescored(v))


@R.add("lda_rescore", None)
def _(v, spark):
    return rescoring.lda_rescore(_rescored(v))


@R.add("best_per_group", "r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, psm_id) AS k FROM v_psms):: SELECT psm_id, group_id, score, is_decoy FROM r WHERE k = 1")
def _(v, spark):
    rank = F.row_number().over(W.partitionBy("group_id").orderBy(F.col("score").desc(), "psm_id"))
    return v("v_psms").withColumn("k", rank).where("k = 1").select("psm_id", "group_id", "score", "is_decoy")
