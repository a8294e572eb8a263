"""Queries that match m/z lists: band joins with their policies, index search, chromatograms and isotopes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..constants import AVERAGINE, C13_DOUBLE, H2O, ISOTOPE_SPACING, NH3, PROTON, S34_SPACING
from ..functions import quality
from ..functions.isotopes import cosine_of, pearson_of
from ..operators import features, grouping, matching, profiles, psm, search
from ..operators.joins import match, tolerance_join
from ..params import Consolidation, FeatureFinding, IsotopeGrouping
from .sequence_queries import FRAGMENTS, item_fragments
from .views import Registry

R = Registry()
_T = ["pep_id", "frag_id"]
_PAIRS = "pairs AS (SELECT t.*, p.* FROM v_targets t JOIN v_peaks p ON mz BETWEEN target_mz - target_mz * 20.0 / 1e6 AND target_mz + target_mz * 20.0 / 1e6)"
_ORDERS = {
    "nearest": "abs(mz - target_mz), peak_id",
    "leftmost": "mz, peak_id",
    "neighbor": "abs((mz - target_mz) / target_mz * 1e6), mz, CASE WHEN mz < target_mz THEN -peak_id ELSE peak_id END",
    "most_intense": "intensity DESC, peak_id",
}


def _band(policy: str, order: str):
    @R.add(f"band_{policy}", f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY pep_id, frag_id ORDER BY {order}) AS k FROM pairs):: SELECT pep_id, frag_id, peak_id, (mz - target_mz) / target_mz * 1e6 AS ppm, intensity FROM r WHERE k = 1", "ppm intensity")
    def _(v, spark):
        got = match(v("v_targets"), v("v_peaks"), 20.0, policy, _T)
        return got.select(*_T, "peak_id", ((F.col("mz") - F.col("target_mz")) / F.col("target_mz") * 1e6).alias("ppm"), "intensity")


for _policy, _order in _ORDERS.items():
    _band(_policy, _order)


@R.add("band_all", f"{_PAIRS}:: SELECT pep_id, frag_id, peak_id FROM pairs")
def _(v, spark):
    return tolerance_join(v("v_targets"), v("v_peaks"), 20.0).select(*_T, "peak_id")


@R.add("band_rt_post", f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY pep_id, frag_id ORDER BY mz, peak_id) AS k FROM pairs), m AS (SELECT *, row_number() OVER (PARTITION BY pep_id ORDER BY frag_id) AS n FROM r WHERE k = 1 AND abs(rt_sec - 300) <= 200):: SELECT pep_id, frag_id, peak_id, abs(rt_sec - 300.0) AS rt_diff FROM m WHERE n <= 50", "rt_diff")
def _(v, spark):
    return matching.candidate_matches(v("v_targets"), v("v_peaks"), "pep_id", "frag_id", 300.0, 200.0, 20.0).select(*_T, "peak_id", "rt_diff")


_NEAREST = f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY pep_id, frag_id ORDER BY {_ORDERS['nearest']}) AS k FROM pairs)"


@R.add("fragment_match", f"{_NEAREST}, m AS (SELECT pep_id, frag_id, peak_id, mz AS observed_mz, intensity AS observed_intensity, (mz - target_mz) / target_mz * 1e6 AS mass_error_ppm FROM r WHERE k = 1 AND intensity >= 2000):: SELECT pep_id, frag_id, coalesce(peak_id, -1) AS peak_id, observed_mz, observed_intensity, mass_error_ppm FROM v_targets LEFT JOIN m USING (pep_id, frag_id)", "observed_mz observed_intensity mass_error_ppm")
def _(v, spark):
    return matching.fragment_matches(v("v_targets"), v("v_peaks"), _T, 20.0, 2000.0, unmatched=True)


@R.add("fragment_coelution", f"{_NEAREST}:: SELECT pep_id, frag_id, peak_id, mz AS observed_mz, intensity AS observed_intensity, mz * (1 + pep_id % 2) - (1 + pep_id % 2) * CAST({PROTON} AS DOUBLE) AS mass_shift, abs(rt_sec - 300.0) AS rt_delta FROM r WHERE k = 1 AND abs(rt_sec - 300) <= 200 AND intensity >= 2000", "observed_mz observed_intensity mass_shift rt_delta")
def _(v, spark):
    own = v("v_targets").withColumn("charge", 1 + F.col("pep_id") % 2)
    return matching.coeluting_matches(own, v("v_peaks"), _T, 300.0, 20.0, 200.0, 2000.0)


@R.add("band_da", "pairs AS (SELECT t.*, p.* FROM v_targets t JOIN v_peaks p ON mz >= target_mz - 0.02 AND mz <= target_mz + 0.02), r AS (SELECT *, row_number() OVER (PARTITION BY pep_id, frag_id ORDER BY abs((mz - target_mz) / target_mz * 1e6), mz, CASE WHEN mz < target_mz THEN -peak_id ELSE peak_id END) AS k FROM pairs):: SELECT pep_id, frag_id, peak_id FROM r WHERE k = 1")
def _(v, spark):
    return match(v("v_targets"), v("v_peaks"), 0.02, "neighbor", _T, unit="Da").select(*_T, "peak_id")


@R.add("band_best_ratio", "pairs AS (SELECT t.*, p.* FROM v_targets t JOIN v_peaks p ON mz >= target_mz - target_mz * 20.0 / 1e6 AND mz < target_mz + target_mz * 20.0 / 1e6), r AS (SELECT *, row_number() OVER (PARTITION BY pep_id, frag_id ORDER BY intensity / (1000.0 + 20 * pep_id) DESC, mz, peak_id) AS k FROM pairs WHERE intensity / (1000.0 + 20 * pep_id) <= 1.5 AND abs(rt_sec - 300) <= 250):: SELECT pep_id, frag_id, peak_id, intensity / (1000.0 + 20 * pep_id) AS ratio FROM r WHERE k = 1", "ratio")
def _(v, spark):
    own = v("v_targets").withColumn("target_intensity", 1000.0 + 20 * F.col("pep_id"))
    return match(own, v("v_peaks"), 20.0, "best_ratio", _T, where=F.abs(F.col("rt_sec") - 300) <= 250, reads=([], ["rt_sec"])).select(*_T, "peak_id", (F.col("intensity") / F.col("target_intensity")).alias("ratio"))


@R.add("normalized_intensity", ":: SELECT peak_id, scan, CASE WHEN max(intensity) OVER (PARTITION BY scan) < 1e-9 THEN intensity ELSE intensity / max(intensity) OVER (PARTITION BY scan) END AS normalized FROM v_peaks", "normalized")
def _(v, spark):
    return matching.normalized(v("v_peaks"), ["scan"]).select("peak_id", "scan", "normalized")


#: Predicted fragments and a spectrum for each of fifty matches, keyed as both sides of the equi-join are.
_SCORED = "fr AS (SELECT pep_id % 50 AS psm_id, pep_id % 2 AS ion_type, frag_id AS position, 1 + pep_id // 200 AS frag_charge, max(target_mz) AS target_mz, max(pep_id) / 400.0 AS predicted FROM v_targets WHERE pep_id % 50 <> 49 GROUP BY ALL), sp AS (SELECT scan AS psm_id, peak_id, mz, intensity FROM v_peaks)"


def _scored(v):
    own = v("v_targets").where("pep_id % 50 <> 49").selectExpr("pep_id % 50 AS psm_id", "pep_id % 2 AS ion_type", "frag_id AS position", "1 + pep_id div 200 AS frag_charge", "target_mz", "pep_id")
    own = own.groupBy("psm_id", "ion_type", "position", "frag_charge").agg(F.max("target_mz").alias("target_mz"), (F.max("pep_id") / 400.0).alias("intensity"))
    spectra = v("v_peaks").select(F.col("scan").cast("long").alias("psm_id"), "peak_id", "mz", "intensity")
    return matching.score_matches(own.drop("target_mz"), own.where("position % 3 <> 1"), spectra, 5.0)


_SCORED_ROWS = f"{_SCORED}, th AS (SELECT * FROM fr WHERE position % 3 <> 1 AND predicted >= 0.01), nr AS (SELECT th.psm_id, ion_type, position, frag_charge, arg_min(intensity, (abs(mz - target_mz), peak_id)) AS observed FROM th JOIN sp ON sp.psm_id = th.psm_id AND mz >= target_mz - 5.0 AND mz <= target_mz + 5.0 GROUP BY ALL), sm AS (SELECT psm_id, ion_type, position, frag_charge, predicted, observed FROM th LEFT JOIN nr USING (psm_id, ion_type, position, frag_charge))"


@R.add("intensity_matches", f"{_SCORED_ROWS}:: SELECT * FROM sm", "predicted observed")
def _(v, spark):
    return _scored(v)


@R.add("intensity_scores", f"{_SCORED_ROWS}:: SELECT psm_id, CASE WHEN count(observed) >= 3 THEN corr(predicted, observed) ELSE 0 END AS corr_all, count(observed) AS n_matched, count(observed) / count(*) AS coverage_predicted FROM sm GROUP BY psm_id", "corr_all coverage_predicted", 5)
def _(v, spark):
    return psm.intensity_correlation(_scored(v)).select("psm_id", "corr_all", "n_matched", "coverage_predicted")


_CHROM = "x AS (SELECT pep_id, frag_id, target_mz, scan, sum(intensity) AS intensity, sum(mz * intensity) AS mass_sum, count(*) AS n FROM v_targets JOIN v_hits ON mz BETWEEN target_mz - target_mz * 50.0 / 1e6 AND target_mz + target_mz * 50.0 / 1e6 GROUP BY ALL)"


@R.add("xic_long", f"{_CHROM}:: SELECT * FROM x", "target_mz intensity mass_sum", 3)
def _(v, spark):
    return profiles.xic(v("v_targets"), v("v_hits"), 50.0)


_ERRORS = """e AS (SELECT *, (mass_sum / intensity - target_mz) / target_mz * 1e6 AS e FROM x WHERE intensity > 0),
  f AS (SELECT pep_id, frag_id, sum(intensity * e) / sum(intensity) AS mean_ppm, sqrt(greatest(sum(intensity * e * e) / sum(intensity) - pow(sum(intensity * e) / sum(intensity), 2), 0)) AS std_ppm FROM e GROUP BY ALL)"""


@R.add("xic_mass_error", f"{_CHROM}, {_ERRORS}:: SELECT *, exp(-std_ppm / 5) AS consistency FROM f", "mean_ppm std_ppm consistency", 4)
def _(v, spark):
    return profiles.mass_errors(profiles.xic(v("v_targets"), v("v_hits"), 50.0))


def _r(n, sx, sy, sxx, syy, sxy) -> str:
    spread = f"sqrt(greatest({n} * {sxx} - {sx} * {sx}, 0) * greatest({n} * {syy} - {sy} * {sy}, 0)) / {n}"
    return f"CASE WHEN {n} >= 2 AND {spread} >= 1e-9 THEN greatest(-1, least(1, ({sxy} - {sx} * {sy} / {n}) / ({spread}))) ELSE 0 END"


@R.add("xic_combined_score", f"""{_CHROM}, {_ERRORS}, t AS (SELECT pep_id, scan, sum(intensity) AS y FROM x GROUP BY ALL), w AS (SELECT pep_id, sum(y) AS sy, sum(y * y) AS syy, max(y) AS top FROM t GROUP BY pep_id),
  g AS (SELECT pep_id, frag_id, sum(intensity) AS sx, sum(intensity * intensity) AS sxx, sum(intensity * y) AS sxy, max(intensity) AS most FROM x JOIN t USING (pep_id, scan) GROUP BY ALL),
  s AS (SELECT pep_id, top, CASE WHEN most >= 10 AND {_r("100.0", "sx", "sy", "sxx", "syy", "sxy")} > 0 THEN {_r("100.0", "sx", "sy", "sxx", "syy", "sxy")} END AS r FROM g JOIN w USING (pep_id)),
  a AS (SELECT pep_id, CASE WHEN count(r) >= 3 AND max(top) >= 100 THEN avg(r) ELSE 0 END AS xic_score FROM s GROUP BY pep_id),
  m AS (SELECT pep_id, avg(CASE WHEN mean_ppm <> 0 THEN abs(mean_ppm) END) AS a, avg(CASE WHEN mean_ppm <> 0 THEN std_ppm END) AS s, avg(exp(-std_ppm / 5)) AS c FROM f GROUP BY pep_id),
  b AS (SELECT pep_id, xic_score, CASE WHEN xic_score = 0 OR a IS NULL THEN 0 ELSE 0.4 * exp(-a / 5) + 0.3 * exp(-s / 3) + 0.3 * c END AS mass_score FROM a LEFT JOIN m USING (pep_id))
  :: SELECT *, CASE WHEN xic_score = 0 THEN 0 ELSE 0.7 * xic_score + 0.3 * mass_score END AS score FROM b""", "xic_score mass_score score", 4)
def _(v, spark):
    return profiles.combined_scores(profiles.xic(profiles.alike_fragments(v("v_targets")), v("v_hits"), 50.0, carry=("weight",)), 100)


_SPECTRA = "sp AS (SELECT DISTINCT scan AS scan_id, CAST(scan AS DOUBLE) * 10 AS rt_sec, 500.0 + CAST(scan % 20 AS DOUBLE) * 0.105 AS q1_center FROM v_peaks), pk AS (SELECT scan AS scan_id, mz, intensity FROM v_peaks), fr AS (SELECT frag_id * 400 + pep_id AS frag_id, target_mz FROM v_targets)"


def _spectra(v):
    scans = v("v_peaks").select(F.col("scan").alias("scan_id")).distinct()
    spectra = scans.select("scan_id", (F.col("scan_id").cast("double") * 10).alias("rt_sec"), (500.0 + (F.col("scan_id") % 20).cast("double") * 0.105).alias("q1_center"))
    frags = v("v_targets").select((F.col("frag_id") * 400 + F.col("pep_id")).alias("frag_id"), "target_mz")
    return frags, spectra, v("v_peaks").select(F.col("scan").alias("scan_id"), "mz", "intensity")


@R.add("q1_profile", f"{_SPECTRA}, near AS (SELECT scan_id, rt_sec, CAST(round_even(q1_center * 100, 0) / 100 AS FLOAT) AS q1 FROM sp WHERE q1_center BETWEEN 501.0 - 0.8 AND 501.0 + 0.8), h AS (SELECT frag_id, q1, sum(intensity) AS intensity FROM fr JOIN (SELECT mz, intensity, q1 FROM pk JOIN near USING (scan_id) WHERE abs(rt_sec - 250) <= 150) ON mz >= target_mz - target_mz * 200.0 / 1e6 AND mz <= target_mz + target_mz * 200.0 / 1e6 GROUP BY ALL):: SELECT frag_id, q1, coalesce(intensity, 0) AS intensity FROM (SELECT fr.frag_id, n.q1 FROM fr CROSS JOIN (SELECT DISTINCT q1 FROM near) n) LEFT JOIN h USING (frag_id, q1)", "q1 intensity", 4)
def _(v, spark):
    return profiles.q1_profile(*_spectra(v), 501.0, 0.8, 250.0, 150.0, 200.0)


@R.add("rt_profile", f"{_SPECTRA}, near AS (SELECT scan_id, CAST(least(49, greatest(0, floor((rt_sec - 100) / (300.0 / 49)))) AS INTEGER) AS rt_bin FROM sp WHERE abs(rt_sec - 250) <= 150), h AS (SELECT frag_id, rt_bin, sum(intensity) AS intensity FROM fr JOIN (SELECT mz, intensity, rt_bin FROM pk JOIN near USING (scan_id)) ON mz >= target_mz - target_mz * 200.0 / 1e6 AND mz <= target_mz + target_mz * 200.0 / 1e6 GROUP BY ALL), bins AS (SELECT CAST(b AS INTEGER) AS rt_bin FROM (SELECT unnest(generate_series(0, 49)) AS b)):: SELECT frag_id, rt_bin, coalesce(intensity, 0) AS intensity, 100 + rt_bin * (300.0 / 49) AS rt_sec FROM (SELECT fr.frag_id, rt_bin FROM fr CROSS JOIN bins) LEFT JOIN h USING (frag_id, rt_bin)", "intensity rt_sec", 4)
def _(v, spark):
    return profiles.rt_profile(*_spectra(v), 250.0, 150.0, 50, 200.0)


@R.add("kernel_corr", ":: SELECT vec_id, CASE WHEN count(*) >= 3 AND sqrt(sum(pow(exp(-0.5 * pow((x - 16.1) / 1.2, 2)), 2))) * sqrt(sum(value * value)) > 0 THEN sum(exp(-0.5 * pow((x - 16.1) / 1.2, 2)) * value) / (sqrt(sum(pow(exp(-0.5 * pow((x - 16.1) / 1.2, 2)), 2))) * sqrt(sum(value * value))) ELSE 0 END AS correlation FROM v_profiles GROUP BY vec_id", "correlation")
def _(v, spark):
    return profiles.kernel_correlation(v("v_profiles").withColumnRenamed("value", "intensity"), "vec_id", "x", 16.1, 1.2)


def _profile_pairs(v):
    own = v("v_profiles").groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("a"))
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@R.add("cosine_profiles", "a AS (SELECT vec_id, list(value ORDER BY pos) AS a FROM v_profiles GROUP BY vec_id):: SELECT p.vec_id, greatest(0, least(1, list_cosine_similarity(p.a, q.a))) AS cosine FROM a p JOIN a q ON q.vec_id = p.vec_id + 1", "cosine")
def _(v, spark):
    return _profile_pairs(v).select("vec_id", cosine_of(F.col("a"), F.col("b")).alias("cosine"))


@R.add("pearson_profiles", ":: SELECT p.vec_id, corr(p.value, q.value) AS r FROM v_profiles p JOIN v_profiles q ON q.vec_id = p.vec_id + 1 AND p.pos = q.pos GROUP BY p.vec_id", "r")
def _(v, spark):
    return _profile_pairs(v).select("vec_id", pearson_of(F.col("a"), F.col("b")).alias("r"))


_W = math.log(1 + 20 / 1e6)
_INDEX = f"ix AS (SELECT CAST(floor(ln(CAST(CAST(target_mz AS FLOAT) AS DOUBLE)) / {_W!r}) AS BIGINT) AS bin, pep_id FROM v_targets), c AS (SELECT bin, count(*) AS n, CAST(ln(1 + (SELECT count(DISTINCT pep_id) FROM ix) / (count(*) + 1)) AS FLOAT) AS idf FROM ix GROUP BY bin)"


def _index(v):
    return search.fragment_index(v("v_targets").select("pep_id", F.col("target_mz").cast("float").alias("mz")))


@R.add("frag_index_idf", f"{_INDEX}:: SELECT bin, n, idf FROM c", "idf", 5)
def _(v, spark):
    return search.bin_idf(_index(v))


def _search_sql(probes: str) -> str:
    return f"""{_INDEX}, {probes}, d AS (SELECT spectrum, CASE WHEN intensity > 0 THEN sqrt(intensity) ELSE 0 END AS w, unnest(generate_series(CAST(floor(ln(mz * (1 - 20.0 / 1e6)) / {_W!r}) AS BIGINT), CAST(floor(ln(mz * (1 + 20.0 / 1e6)) / {_W!r}) AS BIGINT))) AS bin FROM probes),
    f AS (SELECT spectrum, pep_id, sum(w * CAST(idf AS DOUBLE)) AS score, count(*) AS n_matched FROM d JOIN ix USING (bin) JOIN c USING (bin) GROUP BY ALL HAVING count(*) >= 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY spectrum ORDER BY round(score, 6) DESC, pep_id) AS INTEGER) AS rank FROM f):: SELECT spectrum, pep_id, score, n_matched, rank FROM r WHERE rank <= 10"""


@R.add("index_search_topk", _search_sql("probes AS (SELECT scan AS spectrum, mz, intensity FROM v_peaks)"), "score", 4)
def _(v, spark):
    return search.index_search(v("v_peaks").select(F.col("scan").alias("spectrum"), "mz", "intensity"), _index(v))


@R.add("index_search_complementary", _search_sql(f"probes AS (SELECT scan AS spectrum, mz, intensity FROM v_peaks UNION ALL SELECT scan, 1500.0 + scan + 2 * CAST({PROTON} AS DOUBLE) - mz, intensity FROM v_peaks WHERE 1500.0 + scan + 2 * CAST({PROTON} AS DOUBLE) - mz > 0)"), "score", 4)
def _(v, spark):
    own = v("v_peaks").select(F.col("scan").alias("spectrum"), "mz", "intensity")
    return search.index_search(own, _index(v), precursors=own.select("spectrum", (1500.0 + F.col("spectrum")).alias("mass")).distinct())


_RUN = """{name} AS (SELECT {keys}, max(n) AS longest FROM (SELECT {keys}, g, count(*) AS n FROM (SELECT {keys}, sum(o) OVER (PARTITION BY {keys} ORDER BY position, k ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT {keys}, position, k, CASE WHEN position - lag(position) OVER (PARTITION BY {keys} ORDER BY position, k) = 1 THEN 0 ELSE 1 END AS o FROM (SELECT *, {unique} AS k FROM {source}))) GROUP BY ALL) GROUP BY {keys})"""


_PSM = _RUN.format(name="lr", keys="psm_id, ion_type", source="v_matches", unique="fragment") + """, p AS (SELECT DISTINCT psm_id, 12 AS len, CAST(psm_id % 4 + 1 AS INTEGER) AS pc, CAST(psm_id * 10.0 AS DOUBLE) AS pi, 40 + psm_id AS nt FROM v_matches),
  a AS (SELECT psm_id, CAST(count(*) AS DOUBLE) AS match_count, sum(intensity) AS total_intensity, avg(intensity) AS mean_intensity, max(intensity) AS max_intensity, median(intensity) AS median_intensity, stddev_pop(intensity) AS intensity_std,
    avg(abs(ppm)) AS mean_abs_ppm_error, stddev_pop(ppm) AS ppm_error_std, max(abs(ppm)) AS max_abs_ppm_error, avg(rt_diff) AS mean_rt_diff, stddev_pop(rt_diff) AS std_rt_diff, max(rt_diff) AS max_rt_diff, min(rt_diff) AS min_rt_diff, median(rt_diff) AS median_rt_diff,
    CAST(count(*) FILTER (ion_type = 0) AS DOUBLE) AS n_b_ions, CAST(count(*) FILTER (ion_type = 1) AS DOUBLE) AS n_y_ions, CAST(count(*) FILTER (position > 8) AS DOUBLE) AS n_high_mass_ions, CAST(count(*) FILTER (position < 3) AS DOUBLE) AS n_low_mass_ions,
    CASE WHEN count(*) > 1 THEN CAST(max(position) - min(position) AS DOUBLE) / (count(*) - 1) ELSE 0 END AS mean_fragment_spacing,
    array_to_string(list((CASE WHEN ion_type = 0 THEN 'b' ELSE 'y' END) || position || '_' || charge || ':' || printf('%.1f', intensity) ORDER BY fragment), '|') AS matched_fragments_string FROM v_matches GROUP BY psm_id)"""
_PSM_ROWS = """SELECT a.*, coalesce(CAST(b.longest AS DOUBLE), 0) AS b_series_continuity, coalesce(CAST(y.longest AS DOUBLE), 0) AS y_series_continuity, pi AS precursor_intensity, CAST(pc AS DOUBLE) AS precursor_charge, match_count / nt AS coverage, match_count / nt AS match_efficiency,
    CASE WHEN mean_intensity > 0 THEN max_intensity / mean_intensity ELSE 0 END AS intensity_snr, n_y_ions / greatest(n_b_ions, 1) AS y_to_b_ratio, greatest(coalesce(b.longest, 0), coalesce(y.longest, 0)) AS max_continuity, match_count - n_high_mass_ions - n_low_mass_ions AS n_mid_mass_ions
    FROM a JOIN p USING (psm_id) LEFT JOIN lr b ON b.psm_id = a.psm_id AND b.ion_type = 0 LEFT JOIN lr y ON y.psm_id = a.psm_id AND y.ion_type = 1"""
_PSM_DOUBLES = "total_intensity mean_intensity max_intensity median_intensity intensity_std mean_abs_ppm_error ppm_error_std max_abs_ppm_error mean_rt_diff std_rt_diff max_rt_diff min_rt_diff median_rt_diff mean_fragment_spacing coverage match_efficiency intensity_snr y_to_b_ratio max_continuity precursor_intensity"


def _psms(v):
    k = F.col("psm_id")
    return v("v_matches").select("psm_id").distinct().select("psm_id", F.lit("PEPTIDEPEPTR").alias("peptide"), (k % 4 + 1).cast("int").alias("precursor_charge"), (k * 10).cast("double").alias("precursor_intensity"), (40 + k).alias("n_theoretical"))


@R.add("psm_features", f"{_PSM}:: {_PSM_ROWS}", _PSM_DOUBLES, 9)
def _(v, spark):
    return psm.psm_features(v("v_matches"), _psms(v))


_CORR = "corr({x}, {y})"


@R.add("intensity_correlation", """m AS (SELECT psm_id, ion_type, intensity AS x, CASE WHEN fragment % 3 > 0 THEN 100.0 - ppm END AS y FROM v_matches), o AS (SELECT * FROM m WHERE y IS NOT NULL)
  :: SELECT psm_id, CASE WHEN count(y) >= 3 THEN coalesce(corr(x, y) FILTER (y IS NOT NULL), 0) ELSE 0 END AS corr_all, CASE WHEN count(y) FILTER (ion_type = 0) >= 3 THEN coalesce(corr(x, y) FILTER (y IS NOT NULL AND ion_type = 0), 0) ELSE 0 END AS corr_b,
  CASE WHEN count(y) FILTER (ion_type = 1) >= 3 THEN coalesce(corr(x, y) FILTER (y IS NOT NULL AND ion_type = 1), 0) ELSE 0 END AS corr_y, count(y) / count(*) AS coverage_predicted, count(y) AS n_matched FROM m GROUP BY psm_id""", "corr_all corr_b corr_y coverage_predicted", 5)
def _(v, spark):
    own = v("v_matches").select("psm_id", "ion_type", F.col("intensity").alias("predicted"), F.when(F.col("fragment") % 3 > 0, 100.0 - F.col("ppm")).alias("observed"))
    return psm.intensity_correlation(own)


@R.add("match_statistics", ":: SELECT psm_id, count(*) FILTER (fragment % 3 > 0) / count(*) AS coverage, coalesce(sum(intensity) FILTER (fragment % 3 > 0), 0) AS total, coalesce(avg(intensity) FILTER (fragment % 3 > 0), 0) AS mean FROM v_matches GROUP BY psm_id", "coverage total mean", 4)
def _(v, spark):
    return psm.match_statistics(v("v_matches").select("psm_id", F.when(F.col("fragment") % 3 > 0, F.col("intensity")).alias("observed")))


@R.add("hyperscore", FRAGMENTS + """, fr AS (SELECT sequence AS pep_id, ion_type, position, charge, CAST(CAST(mzd AS FLOAT) AS DOUBLE) AS target_mz FROM frags),
  pr AS (SELECT *, row_number() OVER (PARTITION BY pep_id, ion_type, position, charge ORDER BY abs((mz - target_mz) / target_mz * 1e6), mz, CASE WHEN mz < target_mz THEN -peak_id ELSE peak_id END) AS rk FROM fr JOIN v_peaks ON mz BETWEEN target_mz - target_mz * 20.0 / 1e6 AND target_mz + target_mz * 20.0 / 1e6),
  got AS (SELECT * FROM pr WHERE rk = 1), one AS (SELECT * FROM got WHERE charge = 1), """ + _RUN.format(name="lr", keys="pep_id, ion_type", source="one", unique="0") + """,
  a AS (SELECT pep_id, count(*) FILTER (ion_type = 0) AS nb, count(*) FILTER (ion_type = 1) AS ny, count(*) FILTER (ion_type = 0 AND charge = 1) AS n_b_z1, count(*) FILTER (ion_type = 1 AND charge = 1) AS n_y_z1,
    count(*) FILTER (ion_type = 0 AND charge = 2) AS n_b_z2, count(*) FILTER (ion_type = 1 AND charge = 2) AS n_y_z2, coalesce(sum(intensity) FILTER (ion_type = 0), 0) AS ib, coalesce(sum(intensity) FILTER (ion_type = 1), 0) AS iy FROM got GROUP BY pep_id)
  :: SELECT a.pep_id, ln(ib + iy + 1) + ln(factorial(CAST(nb AS INTEGER))) + ln(factorial(CAST(ny AS INTEGER))) AS hs_add, ln(ib + 1) + ln(iy + 1) + ln(factorial(CAST(nb AS INTEGER))) + ln(factorial(CAST(ny AS INTEGER))) AS hs_mul, nb + ny AS n_matched, n_b_z1, n_y_z1, n_b_z2, n_y_z2,
    coalesce(b.longest, 0) AS longest_b, coalesce(y.longest, 0) AS longest_y, ib + iy AS sum_matched FROM a LEFT JOIN lr b ON b.pep_id = a.pep_id AND b.ion_type = 0 LEFT JOIN lr y ON y.pep_id = a.pep_id AND y.ion_type = 1""", "hs_add hs_mul sum_matched", 4)
def _(v, spark):
    return search.hyperscore(item_fragments(v).withColumnRenamed("sequence", "pep_id"), v("v_peaks"))


_DDA = "event_id % 7 + 0.5 AS ppm_error, event_id % 11 AS longest_b, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.25 END AS matched_intensity, value * 2.0 AS hyperscore_mul"


@R.add("dda_features", f"""w AS (SELECT * FROM v_dda JOIN (SELECT event_id AS psm_id, {_DDA} FROM events) USING (psm_id)):: SELECT psm_id, is_decoy, hyperscore, delta_score, matched_peaks, matched_b, matched_y, charge, ln(hyperscore + 1) AS log_hyperscore, ln(matched_peaks + 1) AS log_matched,
  CASE WHEN matched_b + matched_y > 0 THEN least(matched_b, matched_y) / (matched_b + matched_y) ELSE 0 END AS ion_balance, length(sequence) AS peptide_length, CASE WHEN length(sequence) > 1 THEN (matched_b + matched_y) / (2.0 * (length(sequence) - 1)) ELSE 0 END AS coverage,
  len(regexp_extract_all(sequence[1:length(sequence) - 1], '[KR]')) AS missed_cleavages, CASE WHEN matched_b + matched_y > 0 THEN hyperscore / (matched_b + matched_y) ELSE 0 END AS score_per_peak, CASE WHEN hyperscore > 0 THEN delta_score / greatest(hyperscore, 1) ELSE 0 END AS delta_score_ratio,
  ppm_error, longest_b, coalesce(matched_intensity, 0) AS matched_intensity, hyperscore_mul, dl_similarity FROM w""",
    "hyperscore delta_score matched_peaks matched_b matched_y charge log_hyperscore log_matched ion_balance peptide_length coverage missed_cleavages score_per_peak delta_score_ratio ppm_error longest_b matched_intensity hyperscore_mul dl_similarity", 7)
def _(v, spark):
    id_of, value = F.col("psm_id"), F.col("hyperscore")
    more = {"ppm_error": id_of % 7 + 0.5, "longest_b": id_of % 11, "matched_intensity": F.when(id_of % 5 == 0, F.lit(None).cast("double")).otherwise(0.25), "hyperscore_mul": value * 2.0}
    return psm.dda_features(v("v_dda").withColumns(more))


_PATTERN = f"CASE k WHEN 0 THEN 1 ELSE pow(mass * {AVERAGINE!r}, k) / factorial(CAST(k AS INTEGER)) * exp(-mass * {AVERAGINE!r}) END"


def _envelope_sql(targets: str, key: str, n: int, ppm: float) -> str:
    return f"""{targets}, g AS (SELECT *, {_PATTERN} AS theory, (mass + charge * CAST({PROTON} AS DOUBLE)) / charge + k * CAST({ISOTOPE_SPACING} AS DOUBLE) / charge AS target_mz FROM tg, (SELECT unnest(generate_series(0, {n - 1})) AS k)),
  b AS (SELECT g.*, mz, intensity, row_number() OVER (PARTITION BY {key}, k ORDER BY intensity DESC, peak_id) AS rk FROM g JOIN v_peaks ON intensity > 0 AND mz BETWEEN target_mz - target_mz * {ppm} / 1e6 AND target_mz + target_mz * {ppm} / 1e6),
  j AS (SELECT g.*, coalesce(b.intensity, 0) AS y, b.intensity AS i, abs((b.mz - b.target_mz) / b.target_mz * 1e6) AS e FROM g LEFT JOIN (SELECT * FROM b WHERE rk = 1) b USING ({key}, k)),
  a AS (SELECT {key}, count(i) AS found, coalesce(avg(e), 0) AS mean_ppm, {_r(f"{n}.0", "sum(y)", "sum(theory)", "sum(y * y)", "sum(theory * theory)", "sum(y * theory)")} AS correlation FROM j GROUP BY {key})"""


_SCORE = "CASE WHEN found > 0 THEN 0.3 * found / {n} + 0.3 * exp(-mean_ppm / 5) + 0.4 * greatest(0, correlation) ELSE 0 END"


@R.add("isotope_envelope_score", _envelope_sql("tg AS (SELECT peak_id AS key, mz * 2 - 2 * CAST(%s AS DOUBLE) AS mass, 2 AS charge FROM v_peaks)" % PROTON, "key", 5, 20.0) + f":: SELECT *, {_SCORE.format(n=5)} AS score FROM a", "mean_ppm correlation score", 5)
def _(v, spark):
    tg = v("v_peaks").select(F.col("peak_id").alias("key"), (F.col("mz") * 2 - 2 * PROTON).alias("mass"), F.lit(2).alias("charge"))
    return features.envelope(tg, v("v_peaks"), 20.0)


@R.add("neutral_losses", _envelope_sql(f"tg AS (SELECT peak_id AS key, loss, mz * 2 - 2 * CAST({PROTON} AS DOUBLE) - CASE loss WHEN 'H2O' THEN CAST({H2O} AS DOUBLE) ELSE CAST({NH3} AS DOUBLE) END AS mass, 2 AS charge FROM v_peaks, (SELECT unnest(['H2O', 'NH3']) AS loss))", "key, loss", 3, 20.0) + f":: SELECT key, loss, found, {_SCORE.format(n=3)} AS score FROM a", "score", 5)
def _(v, spark):
    tg = v("v_peaks").select(F.col("peak_id").alias("key"), (F.col("mz") * 2 - 2 * PROTON).alias("mass"), F.lit(2).alias("charge"))
    return features.neutral_losses(tg, v("v_peaks"), 20.0)


_MS2 = f"""b AS (SELECT m.*, intensity / i0 / (mass * {AVERAGINE!r}) AS q, row_number() OVER (PARTITION BY m.psm_id, m.fragment ORDER BY intensity DESC, peak_id) AS rk
  FROM m JOIN v_peaks p ON p.intensity > 0 AND p.mz BETWEEN m0 + {ISOTOPE_SPACING} / charge - (m0 + {ISOTOPE_SPACING} / charge) * 30.0 / 1e6 AND m0 + {ISOTOPE_SPACING} / charge + (m0 + {ISOTOPE_SPACING} / charge) * 30.0 / 1e6)"""


@R.add("ms2_isotopes", f"""m AS (SELECT scan AS psm_id, peak_id AS fragment, mz AS m0, intensity AS i0, 1 + peak_id % 2 AS charge, mz * 2 AS mass FROM v_peaks), {_MS2}
  :: SELECT m.psm_id, count(*) AS n_matched, count(*) FILTER (q BETWEEN 0.5 AND 2.0) AS n_isotope, count(*) FILTER (q BETWEEN 0.5 AND 2.0) / count(*) AS fraction FROM m LEFT JOIN (SELECT * FROM b WHERE rk = 1) b USING (psm_id, fragment) GROUP BY m.psm_id""", "fraction")
def _(v, spark):
    own = v("v_peaks").select(F.col("scan").alias("psm_id"), F.col("peak_id").alias("fragment"), "mz", F.col("intensity").alias("m0_intensity"), (1 + F.col("peak_id") % 2).alias("charge"), (F.col("mz") * 2).alias("mass"))
    return features.fragment_isotopes(own, v("v_peaks").select("peak_id", "mz", "intensity"), 30.0)


_EXTENDED = _PSM + f""", f AS ({_PSM_ROWS}), s AS (SELECT psm_id, intensity AS x, CASE WHEN fragment % 3 > 0 THEN 100.0 - ppm END AS y FROM v_matches),
  c AS (SELECT psm_id, CASE WHEN count(y) >= 3 THEN coalesce(corr(x, y) FILTER (y IS NOT NULL), 0) ELSE 0 END AS fragment_intensity_correlation FROM s GROUP BY psm_id),
  ms1 AS (WITH {_envelope_sql(f"tg AS (SELECT psm_id AS key, (200.0 + (CAST(psm_id AS DOUBLE) * 37.5) % 1800.0) * pc - pc * CAST({PROTON} AS DOUBLE) AS mass, pc AS charge FROM p)", "key", 5, 20.0)} SELECT key AS psm_id, {_SCORE.format(n=5)} AS ms1_isotope_score FROM a),
  ms2 AS (WITH m AS (SELECT psm_id, fragment, 200.0 + (CAST(fragment AS DOUBLE) * 7.25) % 1500.0 AS m0, 6000.0 + intensity AS i0, charge, (200.0 + (CAST(fragment AS DOUBLE) * 7.25) % 1500.0) * charge AS mass FROM v_matches), {_MS2.replace("30.0", "100.0")}
    SELECT m.psm_id, count(*) FILTER (q BETWEEN 0.5 AND 2.0) / count(*) AS ms2_isotope_fraction FROM m LEFT JOIN (SELECT * FROM b WHERE rk = 1) b USING (psm_id, fragment) GROUP BY m.psm_id)
  :: SELECT f.*, coalesce(fragment_intensity_correlation, 0) AS fragment_intensity_correlation, coalesce(ms1_isotope_score, 0) AS ms1_isotope_score, coalesce(ms2_isotope_fraction, 0) AS ms2_isotope_fraction,
    CAST(CASE WHEN ms2_isotope_fraction >= 0.5 THEN 0.15 WHEN ms2_isotope_fraction >= 0.3 THEN 0.05 ELSE 0 END AS DOUBLE) AS ms2_isotope_recommended_weight
    FROM f LEFT JOIN c USING (psm_id) LEFT JOIN ms1 USING (psm_id) LEFT JOIN ms2 USING (psm_id)"""


@R.add("extended_features", _EXTENDED, _PSM_DOUBLES + " fragment_intensity_correlation ms1_isotope_score ms2_isotope_fraction ms2_isotope_recommended_weight", 5)
def _(v, spark):
    own, psms, k, peaks = v("v_matches"), _psms(v), F.col("psm_id").cast("double"), v("v_peaks").select("peak_id", "mz", "intensity")
    predicted = own.select("psm_id", "ion_type", F.col("intensity").alias("predicted"), F.when(F.col("fragment") % 3 > 0, 100.0 - F.col("ppm")).alias("observed"))
    z, mz = F.col("precursor_charge"), 200.0 + (F.col("fragment").cast("double") * 7.25) % 1500.0
    precursors = psms.select("psm_id", ((200.0 + (k * 37.5) % 1800.0) * z - z * PROTON).alias("mass"), z.alias("charge"))
    fragments = own.select("psm_id", "fragment", mz.alias("mz"), (6000.0 + F.col("intensity")).alias("m0_intensity"), "charge", (mz * F.col("charge")).alias("mass"))
    return psm.all_features(own, psms, predicted, precursors, peaks, fragments, peaks, ms1_ppm=20.0, ms2_ppm=100.0)


@R.add("cluster_of_peak", f"""c AS (SELECT peak_id AS key, mz AS m0 FROM v_peaks), h AS (SELECT key, z, off, k, m0 + (k - off) * CAST({ISOTOPE_SPACING} AS DOUBLE) / z AS target_mz FROM c, (SELECT unnest([1, 2, 3, 4]) AS z), (SELECT unnest([0, 1, 2, 3]) AS off), (SELECT unnest(generate_series(0, 4)) AS k)),
  b AS (SELECT h.*, mz, row_number() OVER (PARTITION BY key, z, off, k ORDER BY intensity DESC, peak_id) AS rk FROM h JOIN v_peaks ON intensity > 0 AND target_mz > 0 AND mz BETWEEN target_mz - target_mz * 20.0 / 1e6 AND target_mz + target_mz * 20.0 / 1e6),
  g AS (SELECT *, (mz - lag(mz) OVER (PARTITION BY key, z, off ORDER BY k)) / (CAST({ISOTOPE_SPACING} AS DOUBLE) / z) AS gap FROM b WHERE rk = 1),
  f AS (SELECT key, z, off, count(*) AS found, median(gap) AS ratio, max(CASE WHEN k = off THEN 1 ELSE 0 END) AS own FROM g GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY found DESC, z, off) AS rk FROM f WHERE found >= 2 AND own = 1)
  :: SELECT key, CAST(CASE WHEN ratio > 1.7 AND z > 1 THEN z // 2 ELSE z END AS INTEGER) AS charge, CAST(off AS INTEGER) AS offset, found, found / 5 AS score FROM r WHERE rk = 1""", "score")
def _(v, spark):
    own = v("v_peaks")
    return features.cluster_of_peak(own.select(F.col("peak_id").alias("key"), "mz"), own.select("peak_id", F.col("mz"), "intensity"), 20.0)


def _simple_sql() -> str:
    def best(k: int) -> str:
        t = f"(f.mz + {k} * CAST({ISOTOPE_SPACING} AS DOUBLE) / z)"
        return f"""s{k} AS (SELECT f.feature_id, z, p.feature_id AS m{k}_id, p.intensity / f.intensity AS ratio, abs(p.rt - f.rt) AS apart, row_number() OVER (PARTITION BY f.feature_id, z ORDER BY p.intensity / f.intensity DESC, p.mz, p.feature_id) AS rk
        FROM v_features f, zs JOIN v_features p ON p.mz >= {t} - {t} * 30.0 / 1e6 AND p.mz < {t} + {t} * 30.0 / 1e6 AND p.intensity / f.intensity <= 1.5 AND abs(p.rt - f.rt) <= 20)"""

    return f"""zs AS (SELECT unnest([1, 2, 3, 4]) AS z), {best(1)}, {best(2)}, b AS (SELECT s1.*, m2_id, greatest(0, 1 - abs(s1.ratio - 0.6)) + (1 - s1.apart / 20.0) + CASE WHEN m2_id IS NOT NULL THEN 0.5 WHEN z = 1 THEN -0.3 ELSE 0 END AS score FROM s1 LEFT JOIN (SELECT feature_id, z, m2_id FROM s2 WHERE rk = 1) USING (feature_id, z) WHERE s1.rk = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, z DESC) AS r FROM b):: SELECT feature_id, CAST(coalesce(z, 0) AS INTEGER) AS charge, m1_id, coalesce(apart, 0) AS m1_rt_diff FROM v_features LEFT JOIN (SELECT * FROM t WHERE r = 1) USING (feature_id)"""


@R.add("isotope_simple", _simple_sql(), "m1_rt_diff")
def _(v, spark):
    return features.simple_isotopes(v("v_features"), 30.0, 20.0)


def _strict_sql() -> str:
    def near(name: str, source: str, key: str, spacing: str) -> str:
        e = f"((p.mz - s.mz) - {spacing}) / s.mz * 1e6"
        return f"""{name} AS (SELECT * FROM (SELECT s.*, p.feature_id AS p_id, p.mz AS p_mz, p.rt AS p_rt, p.fwhm_sec AS p_fwhm, {e} AS error, row_number() OVER (PARTITION BY {key} ORDER BY abs({e}), p.feature_id) AS rk
        FROM {source} s JOIN v_features p ON p.mz BETWEEN s.mz + {spacing} - s.mz * 0.0001 AND s.mz + {spacing} + s.mz * 0.0001 AND abs({e}) <= 30.0 AND abs(p.rt - s.rt) <= s.fwhm_sec AND p.feature_id <> s.feature_id WHERE s.fwhm_sec > 0) WHERE rk = 1)"""

    sp = f"CAST({ISOTOPE_SPACING} AS DOUBLE)"
    return f"""f AS (SELECT feature_id, mz, rt, fwhm_sec FROM v_features WHERE fwhm_sec > 0), fz AS (SELECT *, z, {sp} / z AS spacing FROM f, (SELECT unnest([1, 2, 3, 4]) AS z)),
    {near("a", "fz", "s.feature_id, s.z", "s.spacing")}, m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY abs(error), z DESC) AS r2 FROM a) WHERE r2 = 1),
    o AS (SELECT feature_id AS id, p_id AS feature_id, p_mz AS mz, p_rt AS rt, p_fwhm AS fwhm_sec, spacing FROM m1), {near("m2", "o", "s.id", "s.spacing")}, {near("c", "f", "s.feature_id", f"CAST({C13_DOUBLE} AS DOUBLE)")}, {near("s34", "f", "s.feature_id", f"CAST({S34_SPACING} AS DOUBLE)")}
    :: SELECT f.feature_id, CAST(coalesce(m1.z, 0) AS INTEGER) AS charge, m1.p_id AS m1_id, m1.error AS m1_error, coalesce(m2.p_id, c.p_id, s34.p_id) AS m2_id, m2.error AS m2_error_from_m1,
    CASE WHEN m2.p_id IS NOT NULL THEN ((m2.p_mz - f.mz) - CASE WHEN abs(m2.p_mz - f.mz - {S34_SPACING}) < abs(m2.p_mz - f.mz - {C13_DOUBLE}) THEN {S34_SPACING} ELSE {C13_DOUBLE} END) / f.mz * 1e6 WHEN c.p_id IS NOT NULL THEN c.error ELSE s34.error END AS m2_error,
    CASE WHEN m2.p_id IS NOT NULL THEN CASE WHEN abs(m2.p_mz - f.mz - {S34_SPACING}) < abs(m2.p_mz - f.mz - {C13_DOUBLE}) THEN '34S' ELSE '13C2' END WHEN c.p_id IS NOT NULL THEN '13C2' WHEN s34.p_id IS NOT NULL THEN '34S' ELSE '' END AS m2_type
    FROM f LEFT JOIN m1 USING (feature_id) LEFT JOIN m2 ON m2.id = f.feature_id LEFT JOIN c ON c.feature_id = f.feature_id LEFT JOIN s34 ON s34.feature_id = f.feature_id"""


@R.add("isotope_strict", _strict_sql(), "m1_error m2_error_from_m1 m2_error", 4)
def _(v, spark):
    return features.isotope_groups(v("v_features"), IsotopeGrouping(ppm=30.0))


@R.add("charge_by_envelope", f"""zk AS (SELECT z, k FROM (SELECT unnest([2, 3, 4]) AS z), (SELECT unnest(generate_series(0, 3)) AS k)), g0 AS (SELECT feature_id, rt, z, k, mz * z - z * CAST({PROTON} AS DOUBLE) AS mass, mz + k * CAST({ISOTOPE_SPACING} AS DOUBLE) / z AS target_mz FROM v_features, zk), g AS (SELECT *, {_PATTERN} AS theory FROM g0),
  b AS (SELECT g.*, p.mz AS p_mz, p.intensity AS i, row_number() OVER (PARTITION BY g.feature_id, z, k ORDER BY p.intensity DESC, p.feature_id) AS rk FROM g JOIN v_features p ON p.intensity > 0 AND abs(p.rt - g.rt) <= 10 AND p.mz BETWEEN target_mz - target_mz * 30.0 / 1e6 AND target_mz + target_mz * 30.0 / 1e6),
  j AS (SELECT g.feature_id, g.z, g.theory, coalesce(i, 0) AS y, i, abs((p_mz - b.target_mz) / b.target_mz * 1e6) AS e FROM g LEFT JOIN (SELECT * FROM b WHERE rk = 1) b USING (feature_id, z, k)),
  a AS (SELECT feature_id, z, count(i) AS found, avg(e) AS e, {_r("4.0", "sum(y)", "sum(theory)", "sum(y * y)", "sum(theory * theory)", "sum(y * theory)")} AS r FROM j GROUP BY ALL),
  s AS (SELECT feature_id, z, (0.3 * found / 4 + 0.3 * exp(-e / 5) + 0.4 * greatest(0, r)) * CASE z WHEN 2 THEN 1.0 WHEN 3 THEN 0.85 ELSE 0.7 END AS score FROM a WHERE found >= 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(score, 9) DESC, z) AS rk FROM s WHERE score >= 0.3):: SELECT feature_id, CAST(z AS INTEGER) AS charge, score FROM t WHERE rk = 1""", "score", 5)
def _(v, spark):
    return features.charge_by_envelope(v("v_features"), 30.0, 10.0)


_M = f"z2 AS (SELECT feature_id AS z2_id, mz * 2 - 2 * CAST({PROTON} AS DOUBLE) AS m2, rt AS rt2, intensity AS i2 FROM v_features WHERE charge = 2), z3 AS (SELECT feature_id AS z3_id, mz * 3 - 3 * CAST({PROTON} AS DOUBLE) AS m3, rt AS rt3, intensity AS i3 FROM v_features WHERE charge = 3)"


@R.add("charge_pairs", f"{_M}, p AS (SELECT *, row_number() OVER (PARTITION BY z2_id ORDER BY abs(m2 - m3), m3, z3_id) AS rk FROM z2 JOIN z3 ON m3 >= m2 - m2 * 50.0 / 1e6 AND m3 < m2 + m2 * 50.0 / 1e6 AND abs(rt3 - rt2) <= 30):: SELECT z2_id, z3_id, abs(m2 - m3) AS error_da, abs(m2 - m3) / m2 * 1e6 AS error_ppm FROM p WHERE rk = 1", "error_da error_ppm", 5)
def _(v, spark):
    return features.charge_pairs(v("v_features"), 50.0, 30.0)


_CONS = Consolidation(50.0, 30.0, 1e3)


@R.add("consolidate", f"""{_M}, e0 AS (SELECT z2_id AS a, z3_id AS b FROM z2 JOIN z3 ON m2 BETWEEN m3 - m3 * 50.0 / 1e6 AND m3 + m3 * 50.0 / 1e6 AND abs(rt3 - rt2) <= 30 AND i2 >= 1000 AND i3 >= 1000), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
  own AS (SELECT feature_id, mz, rt, intensity, charge, mz * charge - charge * CAST({PROTON} AS DOUBLE) AS mass FROM v_features WHERE charge > 0), reach AS (WITH RECURSIVE r(n, m) AS (SELECT a, b FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n, min(m) AS m FROM r GROUP BY n),
  o AS (SELECT own.*, least(feature_id, coalesce(m, feature_id)) AS component FROM own LEFT JOIN reach ON n = feature_id),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component, charge ORDER BY intensity DESC, feature_id) AS rk FROM o) WHERE rk = 1),
  g AS (SELECT component, list_sort(list(charge)) AS charges, sum(intensity) AS total_intensity, arg_max(charge, intensity - charge * 1e-9) AS best_charge FROM k GROUP BY component)
  :: SELECT component, array_to_string(charges, ',') AS charges, total_intensity, CAST(best_charge AS INTEGER) AS best_charge, mass, rt, n_groups, mass_rsd_ppm FROM g JOIN (SELECT component, avg(mass) AS mass, avg(rt) AS rt, count(*) AS n_groups, stddev_pop(mass) / avg(mass) * 1e6 AS mass_rsd_ppm FROM o GROUP BY component) USING (component)""", "total_intensity mass rt mass_rsd_ppm", 4)
def _(v, spark):
    out = features.consolidate(v("v_features").select("feature_id", "mz", "rt", "intensity", "charge"), _CONS)
    return out.select("component", F.array_join("charges", ",").alias("charges"), "total_intensity", "best_charge", "mass", "rt", "n_groups", "mass_rsd_ppm")


@R.add("quality_scores", """b AS (SELECT *, least(100, (CASE WHEN mz_std_ppm < 1 THEN 30 WHEN mz_std_ppm < 2 THEN 25 WHEN mz_std_ppm < 5 THEN 20 WHEN mz_std_ppm < 10 THEN 10 ELSE 0 END) + (CASE WHEN fwhm_sec BETWEEN 1 AND 10 THEN 30 WHEN fwhm_sec BETWEEN 0.5 AND 20 THEN 20 WHEN fwhm_sec > 0 THEN 10 ELSE 0 END)
  + (CASE WHEN n_peaks >= 10 THEN 20 WHEN n_peaks >= 5 THEN 15 WHEN n_peaks >= 3 THEN 10 ELSE 0 END) + (CASE WHEN n_scans >= 5 THEN 10 WHEN n_scans >= 3 THEN 5 ELSE 0 END) + (CASE WHEN intensity / 500 > 100 THEN 10 WHEN intensity / 500 > 10 THEN 7 WHEN intensity / 500 > 1 THEN 3 ELSE 0 END)) AS base,
  (CASE WHEN charge > 0 THEN 10 + (CASE WHEN mz_std_ppm < 1 THEN 5 WHEN mz_std_ppm < 2 THEN 3 WHEN mz_std_ppm < 5 THEN 1 ELSE 0 END) ELSE 0 END) + (CASE WHEN charge > 2 THEN 5 ELSE 0 END) AS bonus FROM v_features)
  :: SELECT feature_id, base, bonus, least((base + bonus) / 120.0 * 100, 100) AS group_quality, least((base + bonus + (CASE WHEN charge >= 2 THEN CASE WHEN mz_std_ppm < 2 THEN 10 WHEN mz_std_ppm < 5 THEN 5 WHEN mz_std_ppm < 10 THEN 2 ELSE 0 END ELSE 0 END)) / 130.0 * 100, 100) AS quality FROM b WHERE least((base + bonus) / 120.0 * 100, 100) >= 70""", "base bonus group_quality quality")
def _(v, spark):
    c = F.col
    own = v("v_features").withColumn("base", quality.base_score(c("mz_std_ppm"), c("fwhm_sec"), c("n_peaks"), c("n_scans"), c("intensity"))).withColumn("bonus", quality.isotope_bonus(c("charge") > 0, c("mz_std_ppm"), c("charge") > 2))
    own = own.withColumn("group_quality", quality.group_score(c("base"), c("bonus"))).withColumn("quality", quality.consolidated_score(c("base"), c("bonus"), quality.charge_bonus(c("charge"), c("mz_std_ppm"))))
    return quality.filter_by_quality(own, "group_quality").select("feature_id", "base", "bonus", "group_quality", "quality")


@R.add("feature_stats", ":: SELECT count(*) AS n, median(intensity) AS median_intensity, avg(intensity) AS mean_intensity, quantile_cont(intensity, 0.9) AS p90_intensity, median(fwhm_sec) AS median_fwhm, quantile_cont(fwhm_sec, 0.9) AS p90_fwhm, " + ", ".join(f"count(*) FILTER (charge = {z}) AS n_z{z}" for z in range(5)) + " FROM v_features", "median_intensity mean_intensity p90_intensity median_fwhm p90_fwhm", 4)
def _(v, spark):
    return features.feature_statistics(v("v_features"))


@R.add("learn_consolidation", f"""o AS (SELECT feature_id, rt, CAST(feature_id % 2000 AS VARCHAR) AS sequence, mz * charge - charge * CAST({PROTON} AS DOUBLE) AS mass, charge FROM v_features WHERE charge > 0), m AS (SELECT sequence, avg(mass) AS mm FROM o GROUP BY sequence HAVING count(DISTINCT charge) >= 2), k AS (SELECT * FROM o JOIN m USING (sequence))
  :: SELECT (SELECT ceil(quantile_cont(abs((mass - mm) / mm * 1e6), 0.95) * 2) / 2 FROM k) AS ppm, (SELECT ceil(quantile_cont(abs(a.rt - b.rt), 0.95)) FROM k a JOIN k b ON a.sequence = b.sequence AND a.feature_id < b.feature_id) AS rt_sec, (SELECT count(DISTINCT sequence) FROM k) AS n_sequences""", "ppm rt_sec")
def _(v, spark):
    own = v("v_features").where("charge > 0").withColumn("sequence", (F.col("feature_id") % 2000).cast("string")).withColumn("score", F.lit(1.0))
    return features.learn_consolidation(own)


_FOUND = FeatureFinding(ppm=40.0, rt_tolerance=30.0, min_intensity=500.0, min_peaks=2, core_rt=20.0)


@R.add("features_greedy", None)
def _(v, spark):
    return features.find_features(v("v_peaks").withColumn("run_id", (F.col("peak_id") % 2).cast("string")), _FOUND)


@R.add("features_core_anneal", None)
def _(v, spark):
    return features.find_features(v("v_peaks").withColumn("run_id", (F.col("peak_id") % 2).cast("string")), _FOUND, anneal=True)


@R.add("coeluting_group", None)
def _(v, spark):
    ref_id = (F.col("frag_id") * 400 + F.col("pep_id")).alias("ref_id")  # every target is a reference of its own
    refs = v("v_targets").join(v("v_peaks").select(F.col("peak_id").alias("pep_id"), F.col("scan").alias("ref_scan")), "pep_id").select(ref_id, F.col("target_mz").alias("ref_mz"), "ref_scan")
    return grouping.grouped_peaks(refs, v("v_peaks"), 100.0)


@R.add("composite_spectrum", None)
def _(v, spark):
    return grouping.composite(v("v_peaks").select(F.col("scan").alias("group_id"), "mz", "intensity"), 50.0)
