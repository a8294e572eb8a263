"""Worked examples, ties, invariants and brute-force comparisons of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom import constants
from peakloom.functions import decoys, isotopes, mass, quality
from peakloom.operators import calibration, fdr, features, grouping, joins, profiles, psm, rescoring, search, sequences, windows
from peakloom.params import Centroiding, Consolidation, FeatureFinding, IsotopeGrouping, Q1Kernel


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).head()


def test_constants_and_presets():
    constants.check()
    assert Centroiding.high_quality().min_bins == 4 and Centroiding.high_sensitivity().noise == 50
    assert Consolidation.preset("mr-tof").rt_tolerance == 5 and IsotopeGrouping.preset("astral").ppm == 3.0
    assert math.isclose(Q1Kernel().sigma, 2.85 / 2.355)
    with pytest.raises(ValueError):
        IsotopeGrouping.preset("quadrupole")


def test_masses(spark):
    r = one(spark, m=mass.neutral_mass(F.lit("PEPTIDE")), c=mass.clean(F.lit("AXZBJUO")), k=mass.codes(F.lit("AC")), u=mass.neutral_mass(F.lit("P*EPTIDE")))
    assert r.m == pytest.approx(799.359965, abs=1e-6) and r.u == pytest.approx(r.m) and r.c == "ALQNLCM" and r.k == [65, 67]
    fixed = mass.fixed_modification(constants.MASSES, "C", 57.021464)
    r = one(spark, a=mass.neutral_mass(F.lit("C"), fixed) - mass.neutral_mass(F.lit("C")), z=mass.mass_from_mz(mass.precursor_mz(F.lit(1000.0), 3), F.lit(3)), f=mass.log_factorial(F.lit(5)), g=mass.log_factorial(F.lit(0)))
    assert r.a == pytest.approx(57.021464) and r.z == pytest.approx(1000.0) and r.f == pytest.approx(math.log(120)) and r.g == 0


def test_modifications(spark):
    r = one(spark, m=mass.parse_modifications(F.lit("Carbamidomethyl@C;Oxidation@M"), F.lit("3;7")), b=mass.parse_modifications(F.lit("b'Oxidation@M'"), F.lit("b'2'")), n=mass.parse_modifications(F.lit("nothing"), F.lit("x")))
    assert [tuple(x) for x in r.m] == [("Carbamidomethyl", 2), ("Oxidation", 6)] and [tuple(x) for x in r.b] == [("Oxidation", 1)] and r.n == []


def test_decoys(spark):
    r = one(spark, **{k: f(F.lit("PEPTIDEK")) for k, f in decoys.METHODS.items()}, short=decoys.diann(F.lit("AK")), s=decoys.shuffled(F.lit("PEPTIDEK")))
    assert (r.diann, r.pseudo_reverse, r.reverse, r.kr_swap, r.short) == ("PEDITPEK", "EDITPEPK", "KEDITPEP", "REDITPEP", "AK")
    assert sorted(r.s) == sorted("PEPTIDEK") and r.s[0] == "P" and r.s[-1] == "K"
    with pytest.raises(ValueError):
        decoys.decoy(F.lit("A"), "other")
    got = rows(decoys.append_decoys(spark.createDataFrame([("ABBA",), ("ACDEF",), ("AEDCF",)], "sequence string")), "sequence", "is_decoy")
    assert [g[:2] for g in got] == [("ABBA", False), ("ACDEF", False), ("AEDCF", False)]  # each decoy is a target


def test_digest_and_fragments(spark):
    prot = spark.createDataFrame([("p1", "MKPAAAAAAKCCCCCCCR"), ("p2", "CCCCCCCR"), ("p3", "")], "protein_id string, sequence string")
    got = {(r.protein_id, r.missed, r.peptide) for r in sequences.digest(prot, 1, 3, 40).collect()}
    assert got == {("p1", 0, "MKPAAAAAAK"), ("p1", 0, "CCCCCCCR"), ("p1", 1, "MKPAAAAAAKCCCCCCCR"), ("p2", 0, "CCCCCCCR")}
    peps = {r.sequence: r for r in sequences.peptides(sequences.digest(prot, 0, 3, 40)).collect()}
    assert peps["CCCCCCCR"].proteins == ["p1", "p2"]
    f = sequences.fragments(spark.createDataFrame([("PEPTIDE",)], "sequence string"), charges=(1,)).toPandas()
    b, y = (f[f.ion_type == t].set_index("position").mz for t in (0, 1))
    whole = 799.359965
    assert all(abs(b[p] + y[7 - p] - whole - 2 * constants.PROTON) < 1e-3 for p in range(1, 7))
    mod = sequences.fragments(spark.createDataFrame([("PEPTIDE",)], "sequence string"), (1,), modifications=F.array(F.struct(F.lit(2).alias("position"), F.lit(10.0).alias("delta")))).toPandas()
    mb, my = (mod[mod.ion_type == t].set_index("position").mz for t in (0, 1))
    assert [round(mb[p] - b[p]) for p in range(1, 7)] == [0, 0, 10, 10, 10, 10] and [round(my[p] - y[p]) for p in range(1, 7)] == [0, 0, 0, 0, 10, 10]


def test_policies_with_ties(spark):
    targets = spark.createDataFrame([(1, 500.0), (2, 600.0), (3, -1.0), (4, 700.0)], "t long, target_mz double")
    peaks = spark.createDataFrame([(1, 499.999, 5.0), (2, 499.999, 9.0), (3, 500.001, 9.0), (4, 600.0, 0.0), (5, 599.995, 1.0), (6, 699.0, 1.0)], "peak_id long, mz double, intensity double")
    pick = lambda policy: {r.t: r.peak_id for r in joins.match(targets, peaks, 10.0, policy, ["t"]).collect()}
    assert pick("nearest") == {1: 1, 2: 4} and pick("leftmost") == {1: 1, 2: 5}
    assert pick("neighbor")[1] == 2 and pick("most_intense") == {1: 2, 2: 5}
    assert joins.match(targets, peaks, 10.0, "all", ["t"]).count() == 5
    with pytest.raises(ValueError):
        joins.match(targets, peaks, 10.0, "other", ["t"])
    left = joins.tolerance_join(targets, peaks, 10.0, how="left")
    assert {r.t for r in left.where("peak_id IS NULL").collect()} == {3, 4}


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    t, p = rng.uniform(200, 300, 300), rng.uniform(200, 300, 2000)
    p[:300] = t * (1 + 20e-6)  # on the edge
    a = spark.createDataFrame(list(enumerate(t.tolist())), "t int, target_mz double")
    b = spark.createDataFrame(list(enumerate(p.tolist())), "peak_id int, mz double")
    want = {(i, j) for i in range(300) for j in np.flatnonzero((p >= t[i] - t[i] * 20.0 / 1e6) & (p <= t[i] + t[i] * 20.0 / 1e6)).tolist()}
    assert {(r.t, r.peak_id) for r in joins.tolerance_join(a, b, 20.0).collect()} == want
    at = spark.createDataFrame([(1.5,), (9.0,)], "x double")
    spans = spark.createDataFrame([(0.0, 2.0), (1.5, 1.6), (3.0, 30.0)], "lo double, hi double")
    assert joins.interval_join(at, spans, "x", "lo", "hi", 2.0).count() == 3


PSMS = [(k, s, d, k // 2) for k, (s, d) in enumerate(zip([5, 4.5, 4, 3, 2.5, 2, 1], [False, True, False, False, True, False, False]))]


def test_fdr_worked_case(spark):
    psms = spark.createDataFrame([(k, float(s), d, g) for k, s, d, g in PSMS], "psm_id long, score double, is_decoy boolean, group_id long")
    got = {r.psm_id: r for r in fdr.q_values(psms).collect()}
    assert [got[k].fdr for k in (0, 2, 3, 5, 6)] == pytest.approx([1, 1, 2 / 3, 0.75, 0.6])
    assert [got[k].q_value for k in (0, 2, 3, 5, 6)] == pytest.approx([0.6] * 5)
    assert fdr.picked(psms).count() == 4 and fdr.picked_fdr(psms).count() == 7
    td = [r.q_value for r in fdr.target_decoy_q(psms).orderBy("psm_id").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(td, td[1:]))
    empty = psms.limit(0)
    assert fdr.q_values(empty).count() == 0 and fdr.target_decoy_q(empty).count() == 0 and fdr.pi0(empty).head().pi0 == 1.0


def test_fdr_ties_against_brute_force(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"psm_id": range(800), "score": rng.integers(0, 60, 800).astype(float), "is_decoy": rng.random(800) < 0.3})
    got = fdr.q_values(spark.createDataFrame(frame)).toPandas().set_index("psm_id")
    t = frame[~frame.is_decoy].sort_values(["score", "psm_id"], ascending=[False, True]).reset_index(drop=True)
    above = np.array([(frame.is_decoy & (frame.score >= s)).sum() for s in t.score])
    f = np.minimum(1, (above + 1) / (np.arange(len(t)) + 1))
    q = np.minimum.accumulate(f[::-1])[::-1]
    assert np.allclose(got.loc[t.psm_id].fdr, f) and np.allclose(got.loc[t.psm_id].q_value, q)


def test_runs(spark):
    got = windows.longest_run(spark.createDataFrame([("a", p) for p in (1, 2, 3, 3, 4, 7)] + [("b", 5)], "k string, p int"), ["k"], "p", "n")
    assert rows(got, "k") == [("a", 3), ("b", 1)]


@pytest.mark.parametrize("anneal", [False, True])
def test_islands_equal_one_greedy_pass(spark, anneal):
    rng = np.random.default_rng(5)
    n = 900
    frame = pd.DataFrame({"run_id": "r", "peak_id": np.arange(n), "scan": rng.integers(0, 40, n), "mz": rng.uniform(400, 402, n), "intensity": rng.integers(1, 40, n) * 100.0, "rt_sec": rng.uniform(0, 300, n)})
    params = FeatureFinding(ppm=20.0, rt_tolerance=6.0, min_intensity=500.0, min_peaks=2, core_rt=4.0)
    want = features.greedy(frame, params, anneal).sort_values("seed_id")
    got = features.find_features(spark.createDataFrame(frame), params, anneal).toPandas().sort_values("seed_id")
    assert len(want) > 20 and want.seed_id.tolist() == got.seed_id.tolist()
    assert np.allclose(want.drop(columns="run_id").to_numpy(float), got.drop(columns="run_id").to_numpy(float))


def test_isotopes(spark):
    r = one(spark, p=isotopes.pattern(F.lit(1200.0), 3), q=isotopes.pattern(F.lit(1200.0), 3, "poisson"), c=isotopes.cosine_of(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), r=isotopes.pearson_of(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(4.0), F.lit(6.0))))
    lam = 1200 * 0.5 / 12 * 0.011
    assert r.p == pytest.approx([1, lam * math.exp(-lam), lam**2 / 2 * math.exp(-lam)]) and r.q[1] == pytest.approx(lam) and r.c == 0 and r.r == pytest.approx(1)
    feats = spark.createDataFrame([(1, 500.0, 10.0, 1000.0, 5.0), (2, 500.0 + 1.003355 / 2, 10.5, 600.0, 5.0), (3, 500.0 + 1.003855, 10.2, 300.0, 5.0), (4, 900.0, 10.0, 100.0, 0.0)], "feature_id long, mz double, rt double, intensity double, fwhm_sec double")
    got = {r.feature_id: r for r in features.simple_isotopes(feats).collect()}
    assert got[1].charge == 2 and got[1].m1_id == 2 and got[4].charge == 0 and got[4].m1_id is None
    strict = {r.feature_id: r for r in features.isotope_groups(feats).collect()}
    assert strict[1].charge == 2 and strict[1].m2_id == 3 and 4 not in strict
    assert {r.feature_id: r.charge for r in features.charge_by_envelope(feats).collect()}[1] == 2


def test_consolidation_follows_chains(spark):
    m = 2000.0
    mz = lambda z, ppm: m * (1 + ppm / 1e6) / z + constants.PROTON
    groups = spark.createDataFrame([(1, mz(2, 0), 10.0, 2e4, 2), (2, mz(3, 2), 10.0, 5e4, 3), (3, mz(2, 4), 10.0, 3e4, 2), (4, 700.0, 10.0, 2e4, 2), (5, 800.0, 10.0, 2e4, 0)], "feature_id long, mz double, rt double, intensity double, charge int")
    got = {r.component: r for r in features.consolidate(groups).collect()}
    assert set(got) == {1, 4} and got[1].n_groups == 3 and got[1].charges == [2, 3] and got[1].best_charge == 3
    assert got[1].total_intensity == 8e4 and got[1].mz_by_charge[2] == pytest.approx(mz(2, 4))


def test_quality_is_capped(spark):
    best = quality.base_score(F.lit(0.5), F.lit(5.0), F.lit(12), F.lit(6), F.lit(1e6))
    r = one(spark, b=best, g=quality.group_score(best, quality.isotope_bonus(F.lit(True), F.lit(0.1), F.lit(True))), w=quality.fragment_isotope_weight(F.lit(0.4)))
    assert r.b == 100 and r.g == 100 and r.w == 0.05


def test_profiles(spark):
    n = 61
    x = np.arange(n) * 0.5
    v = 1000 * np.exp(-0.5 * ((x - 15) / 2) ** 2)
    prof = spark.createDataFrame([(1, k, float(x[k]), float(v[k])) for k in range(n)] + [(2, 0, 0.0, 1.0), (2, 1, 0.5, 2.0)], "id long, pos long, x double, value double")
    got = {r.id: r for r in profiles.fwhm(prof, "id").collect()}
    assert got[1].fwhm == pytest.approx(2 * 2.355, abs=0.05) and got[2].fwhm == -1
    flat = profiles.smooth(spark.createDataFrame([(1, k, 3.0) for k in range(9)], "id long, pos long, value double"), "id", 2.0)
    assert all(abs(r.smoothed - 3) < 1e-12 for r in flat.collect())
    cents = profiles.centroid(spark.createDataFrame([(1, k, 500 + k * 0.004, i) for k, i in enumerate([0.0, 1000.0, 5000.0, 10000.0, 4000.0, 500.0, 0.0, 9000.0, 0.0])], "id long, pos long, x double, value double"), "id").collect()
    assert len(cents) == 1 and cents[0].n_bins == 5 and cents[0].precision_ppm == pytest.approx(1.4)
    shapes = profiles.kernel_shape(prof, "id")
    with pytest.raises(ValueError):
        profiles.learn_kernel(shapes, 15.0)
    assert profiles.auto_sigma(1000.0) == 0.5


def test_xic_counts_zeros(spark):
    t = spark.createDataFrame([(1, k, 400.0 + k) for k in range(3)], "pep_id long, frag_id long, target_mz double")
    peaks = spark.createDataFrame([(s, 400.0 + k, 100.0 * (k + 1) * (1 + s)) for s in range(4) for k in range(3)], "scan int, mz double, intensity double")
    score = profiles.xic_scores(profiles.xic(t, peaks), 10).head()
    assert score.xic_score == pytest.approx(1.0)


def test_psm_and_dda(spark):
    psms = spark.createDataFrame([(1, "PEPTIDEK", 2, 5.0, 10), (2, "AAAK", 3, 1.0, 0)], "psm_id long, peptide string, precursor_charge int, precursor_intensity double, n_theoretical int")
    matches = spark.createDataFrame([(1, k, k % 2, p, 1, float(10 * (k + 1)), 1.0, 2.0) for k, p in enumerate([1, 1, 2, 2, 3, 5])], "psm_id long, fragment long, ion_type int, position int, charge int, intensity double, ppm double, rt_diff double")
    got = {r.psm_id: r for r in psm.psm_features(matches, psms).collect()}
    assert got[1].match_count == 6 and got[1].b_series_continuity == 3 and got[1].y_series_continuity == 2 and got[1].matched_fragments_string.startswith("b1_1:10.0|y1_1:20.0")
    assert got[2].match_count == 0 and got[2].matched_fragments_string == "" and got[2].precursor_charge == 3.0 and len(got[1]) == 31
    with pytest.raises(ValueError, match="sequence"):
        psm.dda_features(psms)
    more = psm.extended_features(psms, spark.createDataFrame([(1, 0.5)], "psm_id long, corr double"))
    assert {r.psm_id: r.corr for r in more.collect()} == {1: 0.5, 2: 0.0}


def test_all_features_of_rescoring(spark):
    psms = spark.createDataFrame([(1, "PEPTIDEK", 2, 5.0, 10), (2, "AAAK", 3, 1.0, 4)], "psm_id long, peptide string, precursor_charge int, precursor_intensity double, n_theoretical int")
    matches = spark.createDataFrame([(1, k, k % 2, k + 1, 1, 10.0, 1.0, 2.0) for k in range(4)], "psm_id long, fragment long, ion_type int, position int, charge int, intensity double, ppm double, rt_diff double")
    predicted = spark.createDataFrame([(1, k % 2, 0.1 * k, None if k == 3 else 5.0 - k) for k in range(4)], "psm_id long, ion_type int, predicted double, observed double")
    precursors = spark.createDataFrame([(1, 1000.0, 2), (2, 1600.0, 3)], "psm_id long, mass double, charge int")
    ms1 = spark.createDataFrame([(1, (1000.0 + 2 * constants.PROTON) / 2, 100.0)], "peak_id long, mz double, intensity double")
    fragments = spark.createDataFrame([(1, 0, 300.0, 100.0, 1, 300.0), (1, 1, 400.0, 100.0, 1, 400.0), (1, 2, 500.0, 100.0, 1, 500.0)], "psm_id long, fragment long, mz double, m0_intensity double, charge int, mass double")
    ms2 = spark.createDataFrame([(1, 300.0 + constants.ISOTOPE_SPACING, 100 * 300 * constants.AVERAGINE), (2, 400.0 + constants.ISOTOPE_SPACING, 1e6)], "peak_id long, mz double, intensity double")
    got = {r.psm_id: r for r in psm.all_features(matches, psms, predicted, precursors, ms1, fragments, ms2).collect()}
    assert len(got) == 2 and len(got[1]) == 35
    assert got[1].fragment_intensity_correlation == pytest.approx(-1.0)  # of the three that were found
    assert 0.3 < got[1].ms1_isotope_score < 1
    assert got[1].ms2_isotope_fraction == pytest.approx(1 / 3) and got[1].ms2_isotope_recommended_weight == 0.05  # one M+1 of three, one far too strong
    assert [got[2][c] for c in ("fragment_intensity_correlation", "ms1_isotope_score", "ms2_isotope_fraction", "ms2_isotope_recommended_weight", "match_count")] == [0.0] * 5


def test_index_search_counts_each_posting(spark):
    frags = spark.createDataFrame([(1, 500.0), (1, 500.0), (2, 700.0)], "pep_id long, mz float")
    peaks = spark.createDataFrame([(1, 500.0, 4.0)], "spectrum long, mz double, intensity double")
    got = search.index_search(peaks, search.fragment_index(frags)).collect()
    assert [(r.pep_id, r.n_matched) for r in got] == [(1, 2)]


def test_recalibration(spark):
    rng = np.random.default_rng(2)
    mz, rt = rng.uniform(300, 1200, 600), rng.uniform(0, 3000, 600)
    shift = 3 + rt / 1000
    frame = spark.createDataFrame(pd.DataFrame({"theoretical_mz": mz, "observed_mz": mz * (1 + shift / 1e6), "rt_sec": rt}))
    fixed = calibration.apply_recalibration(frame, calibration.fit_recalibration(frame), "observed_mz").toPandas()
    assert np.abs((fixed.corrected_mz / fixed.theoretical_mz - 1) * 1e6).max() < 0.5
    assert calibration.fit_recalibration(frame.limit(0)).count() == 10 and calibration.fit_recalibration(frame.limit(5)).count() == 1
    assert calibration.bin_count(10_000) == 100 and calibration.bin_count(120) == 5


def test_rt_model(spark):
    """Against the published definition: harmonic means of secants inside, one-sided slopes kept monotone at the ends."""
    x = np.sort(np.random.default_rng(4).uniform(0, 100, 60))
    y = 20 + 5 * x + 3 * np.sin(x / 10)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", 1.0, 7.0)]
    pairs = spark.createDataFrame(rows, "run_id string, irt double, rt_sec double")
    seg = calibration.pchip_segments(calibration.robust_pairs(pairs)).where("run_id = 'a'").orderBy("x0").toPandas()
    width, secant = np.diff(x), np.diff(y) / np.diff(x)
    share = (2 * width[1:] + width[:-1]) / (3 * (width[1:] + width[:-1]))  # of the left secant's reciprocal
    assert np.allclose(seg.m0[1:], 1 / (share / secant[:-1] + (1 - share) / secant[1:]))
    assert np.allclose(seg.m1[:-1], seg.m0[1:]) and (seg.m0 >= 0).all() and (seg.m1 >= 0).all()
    model = calibration.fit_rt(pairs)
    at = np.linspace(x[0], x[-1], 50)
    got = calibration.predict_rt(spark.createDataFrame([("a", float(v)) for v in [*at, *x]] + [("b", 3.0), ("c", 1.0)], "run_id string, irt double"), model).toPandas()
    own = got[got.run_id == "a"].sort_values("irt").drop_duplicates("irt")
    assert (np.diff(own.predicted) >= -1e-9).all() and np.allclose(own[own.irt.isin(x)].predicted, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t, h = (at - x[k]) / width[k], width[k]
    m0, m1 = seg.m0.to_numpy()[k], seg.m1.to_numpy()[k]
    c2, c3 = 3 * (y[k + 1] - y[k]) - h * (2 * m0 + m1), -2 * (y[k + 1] - y[k]) + h * (m0 + m1)  # the cubic in powers of t
    assert np.allclose(own[own.irt.isin(at)].predicted, y[k] + h * m0 * t + c2 * t**2 + c3 * t**3, atol=1e-6)
    assert got[got.run_id == "b"].predicted.item() == 7.0 and math.isnan(got[got.run_id == "c"].predicted.item())


def test_left_tolerance_join_with_nulls(spark):
    targets = spark.createDataFrame([(1, 500.0, None), (2, 600.0, "x"), (3, None, None), (2, 600.0, "x"), (4, 700.0, None)], "id int, target_mz double, note string")
    peaks = spark.createDataFrame([(10, 500.001), (11, 500.002), (12, 900.0)], "peak_id int, mz double")
    got = sorted((r.id, r.peak_id or 0) for r in joins.tolerance_join(targets, peaks, 10.0, how="left").collect())
    assert got == [(1, 10), (1, 11), (2, 0), (2, 0), (3, 0), (4, 0)]


@pytest.mark.parametrize("tolerance,unit", [(200.0, "ppm"), (3000.0, "ppm"), (1.0, "ppm"), (0.25, "Da")])
def test_tolerance_join_finds_every_pair(spark, tolerance, unit):
    """A wide window reaches over a bin's whole width; none of its peaks may lie in a bin between."""
    rng = np.random.default_rng(3)
    t, m = rng.uniform(400, 440, 400), rng.uniform(400, 440, 1500)
    targets, peaks = spark.createDataFrame([(k, float(x)) for k, x in enumerate(t)], "id int, target_mz double"), spark.createDataFrame([(k, float(x)) for k, x in enumerate(m)], "peak_id int, mz double")
    tol = t * tolerance / 1e6 if unit == "ppm" else np.full(400, tolerance)
    want = {(i, j) for i in range(400) for j in np.flatnonzero((m >= t[i] - tol[i]) & (m <= t[i] + tol[i])).tolist()}
    assert {(r.id, r.peak_id) for r in joins.tolerance_join(targets, peaks, tolerance, unit=unit).collect()} == want


def test_match_in_daltons_and_by_ratio(spark):
    rng = np.random.default_rng(8)
    t, m, i = rng.uniform(100, 120, 60), rng.uniform(100, 120, 400), rng.uniform(1, 100, 400)
    targets = spark.createDataFrame([(k, float(v), 40.0) for k, v in enumerate(t)], "id int, target_mz double, target_intensity double")
    peaks = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(m, i))], "peak_id int, mz double, intensity double")
    got = {r.id: r.peak_id for r in joins.match(targets, peaks, 0.05, "nearest", ["id"], unit="Da").collect()}
    assert got == {k: int(np.abs(m - v).argmin()) for k, v in enumerate(t) if np.abs(m - v).min() <= 0.05}
    got = {r.id: r.peak_id for r in joins.match(targets, peaks, 0.05, "best_ratio", ["id"], unit="Da").collect()}
    fits = {k: [j for j in range(400) if v - 0.05 <= m[j] < v + 0.05 and i[j] / 40 <= 1.5] for k, v in enumerate(t)}
    assert got == {k: max(js, key=lambda j: i[j]) for k, js in fits.items() if js}
    with pytest.raises(ValueError):
        joins.match(targets, peaks, 0.05, "other", ["id"])


def test_quantiles_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(windows, "EXACT_ROWS", 100)
    values = [*np.random.default_rng(1).normal(0, 1, 4000).round(2).tolist(), *[0.25] * 2000]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    assert windows.quantiles(rows, "v", [0.0, 0.25, 0.5, 0.95, 1.0]) == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.95, 1]).tolist())
    assert windows.quantiles(rows.limit(0), "v", [0.5]) == [None]


def test_fdr_in_many_ranges(spark, monkeypatch):
    """Ties, a score that a third of all rows have, and ranges of few rows give what one range gives."""
    rng = np.random.default_rng(2)
    score = np.where(rng.random(900) < 0.33, 0.5, rng.normal(0, 1, 900).round(1))
    rows = spark.createDataFrame([(k, float(s), bool(d), k % 3 if k % 7 else None) for k, (s, d) in enumerate(zip(score, rng.random(900) < 0.3))], "psm_id long, score double, is_decoy boolean, tier int")
    runs = []
    for n in (1_000_000, 40):
        monkeypatch.setattr(fdr, "RANGE_ROWS", n)
        runs.append([{r.psm_id: (r.fdr, r.q_value) for r in fdr.q_values(rows).collect()}, *({r.psm_id: r.q_value for r in fdr.target_decoy_q(rows, tier=t).collect()} for t in (None, "tier"))])
    assert runs[0] == runs[1] and len(runs[0][1]) == 900
    assert all(runs[0][2][k] == 1.0 for k in range(0, 900, 7))


def test_forest_by_tier(spark):
    rng = np.random.default_rng(6)
    rows = [(k, bool(k % 2), "abc"[k % 3] if k % 50 else None, float(rng.normal(0 if k % 2 else 2, 1)), float(rng.normal(0, 1))) for k in range(900)]
    own = spark.createDataFrame([*rows, (1000, False, "few", 9.0, 0.0)], "psm_id long, is_decoy boolean, tier string, log_hyperscore double, noise double")
    got = rescoring.rf_rescore(own, rounds=1, trees=5, depth=3, q=0.1, least=20, tier="tier").toPandas().set_index("psm_id")
    assert len(got) == 901 and (got.q_value[got.tier.isna()] == 1).all() and (got[~got.is_decoy].rf_score.mean() > got[got.is_decoy].rf_score.mean())
    for _, part in got[got.tier.notna()].groupby("tier"):
        part = part.reset_index().sort_values(["rf_score", "psm_id"], ascending=[False, True])
        rate = part.is_decoy.cumsum() / (~part.is_decoy).cumsum().clip(lower=1)
        assert np.allclose(part.q_value, np.minimum(rate[::-1].cummin()[::-1], 1))


def test_digest_proteins(spark):
    own = spark.createDataFrame([(1, "PEPTIDEKAAAAAAAR", "x GN=ABC y"), (2, "PEPTIDEK", None), (3, None, "GN=Z")], "protein_id long, sequence string, description string")
    peptides, proteins = sequences.digest_proteins(own, 0)
    assert {(r.sequence, tuple(r.proteins), r.n_occurrences) for r in peptides.collect()} == {("PEPTIDEK", (1, 2), 2), ("AAAAAAAR", (1,), 1)}
    assert [(r.gene, r.length, r.n_peptides) for r in proteins.orderBy("protein_id").collect()] == [("ABC", 16, 2), ("", 8, 1), ("Z", None, 0)]
    shuffled = decoys.append_decoys(peptides, "shuffle").where("is_decoy").collect()
    assert {"".join(sorted(r.sequence)) for r in shuffled} <= {"".join(sorted(s)) for s in ("PEPTIDEK", "AAAAAAAR")}


def test_grouping(spark):
    peaks = spark.createDataFrame([(k, s, m, i) for k, (s, m, i) in enumerate([(0, 500.0, 100.0), (1, 500.001, 110.0), (0, 500.01, 90.0), (1, 500.01, 95.0), (0, 600.0, 50.0)])], "peak_id long, scan int, mz double, intensity double")
    refs = spark.createDataFrame([(0, 500.0, 0)], "ref_id long, ref_mz double, ref_scan int")
    got = {r.peak_id for r in grouping.grouped_peaks(refs, peaks, 20.0, 1).collect()}
    assert got == {0, 1, 2, 3}
    comp = grouping.composite(spark.createDataFrame([(1, 500.0, 100.0), (1, 500.004, 90.0), (1, 500.008, 85.0), (1, 600.0, 50.0)], "group_id long, mz double, intensity double"), 20.0)
    assert [(r.n, r.intensity) for r in comp.orderBy("mz").collect()] == [(3, 275.0), (1, 50.0)]


def test_rescoring_separates(spark):
    rng = np.random.default_rng(6)
    n = 1500
    decoy = rng.random(n) < 0.4
    good = ~decoy & (rng.random(n) < 0.6)
    frame = pd.DataFrame({"psm_id": range(n), "is_decoy": decoy, "log_hyperscore": rng.normal(0, 1, n) + 4 * good, "delta": rng.normal(0, 1, n) + 2 * good})
    own = spark.createDataFrame(frame)
    for got, score in ((rescoring.rf_rescore(own, trees=10, depth=4, rounds=1), "rf_score"), (rescoring.lda_rescore(own), "lda_score")):
        got = got.toPandas().set_index("psm_id").loc[frame.psm_id]
        assert got[score][good].mean() > got[score][decoy].mean() and (got.q_value <= 1).all()


def test_window_totals_equal_the_pairs(spark):
    """Edges, repeats, ties, nulls, NaN and clashing columns; the sums are those of all pairs."""
    rng = np.random.default_rng(5)
    near = 500 * (1 + rng.integers(-30, 31, 400) * 1e-6)
    mzs = [*map(float, near), 500.0, 500.0, 500 - 500 * 5 / 1e6, 500 + 500 * 5 / 1e6, None, float("nan"), 0.0, -3.0]
    peaks = spark.createDataFrame([(m, k % 3, 1) for k, m in enumerate(mzs)], "mz double, a long, b long")
    wanted = [500.0, 500.0, *map(float, near[:50]), 900.0, None, float("nan"), 0.0, -500.0]
    targets = spark.createDataFrame(list(enumerate(wanted)), "id int, target_mz double")
    for ppm in (5.0, 20.0):
        want = []
        for k, t in enumerate(wanted):
            if t is not None and t > 0:
                hit = [(j % 3, 1) for j, m in enumerate(mzs) if m is not None and m > 0 and t - t * ppm / 1e6 <= m <= t + t * ppm / 1e6]
                want += [(k, sum(x for x, _ in hit), len(hit))] if hit else []
        assert rows(joins.window_totals(targets, peaks, ppm, ["a", "b"]).select("id", "a", "b"), "id") == want
    assert joins.window_totals(targets, peaks.limit(0), 5.0, ["a", "b"]).count() == 0
    assert joins.window_totals(targets.limit(0), peaks, 5.0, ["a", "b"]).columns == ["id", "target_mz", "a", "b"]


def slow_group(ref_mz, ref_scan, peaks, ppm=100.0, reach=5, least=0.8):
    """Ids of the peaks that co-elute with one reference; peaks: rows (peak_id, scan, mz, intensity) by id."""
    inside = [p for p in peaks if abs(p[1] - ref_scan) <= reach]
    near = [p for p in inside if ref_mz - ref_mz * 3 * ppm / 1e6 <= p[2] <= ref_mz + ref_mz * 3 * ppm / 1e6]
    centers, left = [], list(near)
    while left:
        seed = left[0][2]
        got = [p for p in left if abs(p[2] - seed) <= seed * 11 / 1e6]
        centers.append(np.mean([p[2] for p in got]))
        left = [p for p in left if p not in got]
    traces = [{} for _ in centers]
    for _, scan, mz, intensity in near:
        off = [abs(mz - c) if abs(mz - c) <= c * 11 / 1e6 else np.inf for c in centers]
        if min(off) < np.inf:
            own = traces[int(np.argmin(off))]
            own[scan] = own.get(scan, 0.0) + intensity
    found = set()
    for k, (c, own) in enumerate(zip(centers, traces)):
        if not own or not traces[0]:
            continue
        norm = math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in traces[0].values()))
        if k == 0 or sum(x * traces[0].get(s, 0.0) for s, x in own.items()) / norm >= least:
            found |= {p[0] for p in inside if c - c * 11 / 1e6 <= p[2] <= c + c * 11 / 1e6}
    return found


def test_every_target_is_a_reference(spark, tmp_path):
    from peakloom.plans import registry

    rng = np.random.default_rng(3)
    parts = [(k, (300.0 + 40 * (k % 7) + 0.01 * (k // 400)) / 1.37) for k in (*range(0, 12), *range(395, 412), *range(800, 806), 1201)]
    orders = [(k, int(rng.integers(0, 600)), float(300 + 40 * rng.integers(0, 7) + rng.integers(-30, 31) * 0.004)) for k in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.ref_id, r.peak_id) for r in registry.QUERIES["coeluting_group"](spark, str(tmp_path)).collect()}
    peaks = [(k, c % 50, 200 + t % 1800, 100 + t * 13 % 9000) for k, c, t in orders]
    want = {(k, p) for k, price in parts for p in slow_group(200 + price * 1.37 % 1800, peaks[k % 400][1], peaks)}
    assert got == want and {k // 400 for k, _ in got} == {0, 1, 2, 3}


def test_q_values_have_no_frame_that_ends_at_the_last_row(spark):
    """Such a frame is computed anew for every row, so its time grows as the square."""
    from peakloom.operators import fdr

    rows = [(k, float((k * 7919) % 101), k % 3 == 0, k % 2) for k in range(500)]
    psms = spark.createDataFrame(rows, "psm_id long, score double, is_decoy boolean, tier long")
    for tier in (None, "tier"):
        out = fdr.target_decoy_q(psms, tier=tier)
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        got = {r["psm_id"]: r["q_value"] for r in out.collect()}
        for part in {r[3] for r in rows} if tier else {None}:
            own = sorted((r for r in rows if part is None or r[3] == part), key=lambda r: (-r[1], r[0]))
            rates, decoys = [], 0
            for k, r in enumerate(own):
                decoys += r[2]
                rates.append(decoys / max(k + 1 - decoys, 1))
            assert all(abs(got[r[0]] - min(1.0, min(rates[k:]))) < 1e-12 for k, r in enumerate(own))


def test_match_equals_loops_and_joins_no_pairs(spark):
    """Copies of targets and peaks, ties on both sides, both units, open tops: one best peak each, by plain loops."""
    import random

    from peakloom.operators import joins

    rng = random.Random(5)
    targets = [(k, k % 2, rng.choice([400.0, 500.0, 500.005, 500.01, 0.001, 900.0]) + rng.randrange(4) / 256) for k in range(60)]
    peaks = [(k, k % 2, rng.choice([400.0, 500.0, 900.0]) + rng.randrange(-8, 9) / 256, float(rng.randrange(4))) for k in range(300)]
    t = spark.createDataFrame(targets, "pep_id long, of long, target_mz double")
    p = spark.createDataFrame(peaks, "peak_id long, by long, mz double, intensity double")
    rank = {
        "nearest": lambda x, q: (abs(q[2] - x), q[0]), "leftmost": lambda x, q: (q[2], q[0]), "most_intense": lambda x, q: (-q[3], q[0]),
        "neighbor": lambda x, q: (abs((q[2] - x) / x * 1e6), q[2], -q[0] if q[2] < x else q[0]),
    }
    for policy, of in rank.items():
        for unit, tolerance, open_top, same in (("ppm", 20.0, False, None), ("ppm", 30.0, True, {"of": "by"}), ("Da", 0.015625, False, {"of": "by"}), ("Da", 1.0, True, None)):
            got = {r["pep_id"]: r["peak_id"] for r in joins.match(t, p, tolerance, policy, ["pep_id"], open_top=open_top, unit=unit, same=same).collect()}
            want = {}
            for pep, group, x in targets:
                tol = x * tolerance / 1e6 if unit == "ppm" else tolerance
                near = [q for q in peaks if x - tol <= q[2] and (q[2] < x + tol if open_top else q[2] <= x + tol) and (same is None or q[1] == group) and (policy != "most_intense" or q[3] > 0)]
                if near:
                    want[pep] = min(near, key=lambda q: of(x, q))[0]
            assert got == want, (policy, unit, open_top)
    plan = joins.match(t, p, 20.0, "most_intense", ["pep_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__peak_bin" not in plan  # the pairs of the band join


def test_neighbor_reads_peaks_once_and_others_carry_one_peak(spark):
    import re

    from peakloom.operators import joins
    from peakloom.plans.views import view
    from tests.conftest import DATA

    targets, peaks = view(spark, DATA, "v_targets"), view(spark, DATA, "v_peaks")
    for policy in joins.SCANNED:
        plan = joins.match(targets, peaks, 20.0, policy, ["pep_id", "frag_id"])._jdf.queryExecution().optimizedPlan()
        assert len(re.findall(r"Relation \[o_orderkey", plan.toString())) == 1, policy
        assert (policy == "neighbor") == bool(re.search(r"AS q#", plan.toString())), policy

    of_none = spark.createDataFrame([(1, None, 500.0), (2, 3, 500.0)], "pep_id long, of long, target_mz double")
    by_none = spark.createDataFrame([(1, None, 500.0, 9.0), (2, 3, 500.0, 5.0)], "peak_id long, by long, mz double, intensity double")
    for policy in joins.SCANNED:  # null equals nothing
        assert [(r.pep_id, r.peak_id) for r in joins.match(of_none, by_none, 20.0, policy, ["pep_id"], same={"of": "by"}).collect()] == [(2, 2)], policy


def test_no_broadcast_is_chosen_by_the_size_of_files(spark):
    from peakloom.operators import joins
    from peakloom.plans.views import view
    from tests.conftest import DATA

    targets, peaks = view(spark, DATA, "v_targets"), view(spark, DATA, "v_peaks")
    for out in (joins.tolerance_join(targets, peaks, 20.0), joins.match(targets, peaks, 20.0, "nearest", ["pep_id", "frag_id"])):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_consolidation_of_copies_makes_links_of_classes_only(spark, monkeypatch):
    """Two hundred copies of one doubly and one triply charged group: one component, over one link."""
    from peakloom.constants import PROTON
    from peakloom.operators import features
    from peakloom.params import Consolidation

    rows = [(z * 1000 + k, 1000.0 / z + PROTON, 60.0, 2e4, z) for z in (2, 3) for k in range(200)] + [(k, 700.0, 60.0, 2e4, 2) for k in range(3)] + [(9000, 1000.0 / 2 + PROTON, 60.0, 1.0, 2)]
    groups, made, real = spark.createDataFrame(rows, "feature_id long, mz double, rt double, intensity double, charge int"), [], features.components
    monkeypatch.setattr(features, "components", lambda nodes, edges: made.append(edges.count()) or real(nodes, edges))
    got = {r["component"]: r["n_groups"] for r in features.consolidate(groups, Consolidation()).collect()}
    assert got == {2000: 400, 0: 1, 1: 1, 2: 1, 9000: 1} and made == [1]


def test_profiles_of_ids_with_several_rows(spark):
    from peakloom.operators import profiles

    fragments = spark.createDataFrame([(1, 500.0), (1, 600.0), (2, 500.0), (3, 700.0)], "frag_id long, target_mz double")
    spectra = spark.createDataFrame([(1, 10.0, 501.0), (2, 30.0, 501.2)], "scan_id long, rt_sec double, q1_center double")
    peaks = spark.createDataFrame([(1, 500.0, 5.0), (1, 500.0, 6.0), (1, 600.0, 7.0)], "scan_id long, mz double, intensity double")
    got = sorted((r["frag_id"], round(r["q1"], 2), r["intensity"]) for r in profiles.q1_profile(fragments, spectra, peaks, 501.0, 0.8, 10.0, 5.0).collect())
    assert got == [(1, 501.0, 18.0)] * 2 + [(1, 501.2, 0.0)] * 2 + [(2, 501.0, 11.0), (2, 501.2, 0.0), (3, 501.0, 0.0), (3, 501.2, 0.0)]
    plan = profiles.q1_profile(fragments, spectra, peaks, 501.0, 0.8, 10.0, 5.0)
    assert sum(r["intensity"] for r in plan.collect()) == 47.0


def test_charge_pairs_of_copies_join_one_of_each(spark, monkeypatch):
    from peakloom.constants import PROTON
    from peakloom.operators import features

    rows = [(z * 1000 + k, 1000.0 / z + PROTON, 60.0, 2e4, z) for z in (2, 3) for k in range(100)]
    own, made, real = spark.createDataFrame(rows, "feature_id long, mz double, rt double, intensity double, charge int"), [], features.tolerance_join
    monkeypatch.setattr(features, "tolerance_join", lambda a, b, *r, **k: made.append((a.count(), b.count())) or real(a, b, *r, **k))
    assert sorted((r["z2_id"], r["z3_id"]) for r in features.charge_pairs(own).collect()) == [(2000 + k, 3000) for k in range(100)]
    assert made == [(1, 1)]


def test_retention_ties_stay_in_one_run(spark):
    """Equal pairs at the start of a run all belong to it, whichever of them opens it."""
    from peakloom.operators import calibration

    rows = [("a", x, 5.0) for x in (0.9, 0.91) for _ in range(200)]
    got = calibration.merged(spark.createDataFrame(rows, "run_id string, irt double, rt_sec double")).collect()
    assert sorted(round(r["irt"], 9) for r in got) == [0.9, 0.91]


def test_references_alike_are_grouped_once(spark, monkeypatch):
    """Copies of a reference have the pairs of the first; an id with two m/z has those of both."""
    peaks = spark.createDataFrame([(k, s, m, i) for k, (s, m, i) in enumerate([(0, 500.0, 100.0), (1, 500.001, 110.0), (0, 500.01, 90.0), (1, 500.01, 95.0), (0, 600.0, 50.0)])], "peak_id long, scan int, mz double, intensity double")
    refs = spark.createDataFrame([(k, 500.0, 0) for k in range(100)] + [(7, 600.0, 0), (7, 500.0, 0), (200, 700.0, 0), (201, None, 0)], "ref_id long, ref_mz double, ref_scan int")
    made, real = [], grouping.rt_profiles
    monkeypatch.setattr(grouping, "rt_profiles", lambda few, *r: made.append(few.where("ref_mz IS NOT NULL").count()) or real(few, *r))
    got = sorted((r.ref_id, r.peak_id) for r in grouping.grouped_peaks(refs, peaks, 20.0, 1).collect())
    assert got == sorted([(k, p) for k in range(100) for p in range(4)] + [(7, 4)]) and made == [3]


def test_fragments_alike_are_scored_once(spark):
    """Fragments of one peptide and m/z stand for one another; repeats of a row and ids of two m/z keep their own sums."""
    targets = [(1, k, 400.0 + k % 3) for k in range(60)] + [(1, 70, 400.0), (1, 70, 401.0), (1, 71, 402.0), (1, 71, 402.0), (2, 0, 400.0), (2, 1, 401.0), (2, 2, 402.0), (3, 5, 900.0), (None, 1, 400.0)]
    own = spark.createDataFrame(targets, "pep_id long, frag_id long, target_mz double")
    peaks = spark.createDataFrame([(s, (400.0 + k) * (1 + (s - 2) * 1e-6), 100.0 * (k + 1) * (1 + s) + 37.0 * ((s * 5 + k * 3) % 4)) for s in range(5) for k in range(3)] + [(None, 400.0, 55.0)], "scan int, mz double, intensity double")
    few = profiles.alike_fragments(own)
    assert sorted((r.pep_id or 0, r.target_mz, r.weight) for r in few.collect()) == [(0, 400.0, 1), (1, 400.0, 1), (1, 400.0, 20), (1, 401.0, 1), (1, 401.0, 20), (1, 402.0, 1), (1, 402.0, 1), (1, 402.0, 20), (2, 400.0, 1), (2, 401.0, 1), (2, 402.0, 1), (3, 900.0, 1)]
    got = rows(profiles.combined_scores(profiles.xic(few, peaks, 20.0, carry=("weight",)), 10), "pep_id")
    want = rows(profiles.combined_scores(profiles.xic(own, peaks, 20.0), 10), "pep_id")
    assert len(got) == 2 and all(a == pytest.approx(b, rel=1e-9) for a, b in zip(got, want)) and got[0][1] > 0 and got[0][2] > 0
    whole = profiles.mass_errors(profiles.xic(own, peaks, 20.0)).where("pep_id = 2").toPandas()
    assert got[1][2] == pytest.approx(0.4 * math.exp(-whole.mean_ppm.abs().mean() / 5) + 0.3 * math.exp(-whole.std_ppm.mean() / 3) + 0.3 * whole.consistency.mean(), rel=1e-6)


def test_composite_of_copies_and_many_chains(spark):
    """Against one loop over a group's peaks in m/z order; copies, odd m/z and a missing group; many chains in one call."""
    rng = np.random.default_rng(8)
    peaks = [(int(g), float(500 + 0.004 * m), float(i)) for g, m, i in zip(rng.integers(0, 4, 900), rng.integers(0, 600, 900), rng.integers(1, 50, 900))] + [(None, 500.0, 1.0), (None, 500.001, 2.0), (1, None, 4.0), (1, None, 4.0), (1, -5.0, 1.0), (1, -5.0, 1.0), (1, float("nan"), 3.0)]
    out = grouping.composite(spark.createDataFrame(peaks * 3, "group_id long, mz double, intensity double"), 10.0)
    want = []
    for group in {p[0] for p in peaks}:
        mean, own = None, sorted(p[1:] for p in peaks * 3 if p[0] == group and p[1] is not None and p[1] > 0)
        for mz, intensity in own:
            if mean is not None and abs(mz - mean) <= mean * 10.0 / 1e6:
                mean, total, n = (mean * n + mz) / (n + 1), total + intensity, n + 1
                want[-1] = (group, mean, total, n)
            else:
                mean, total, n = mz, intensity, 1
                want.append((group, mz, intensity, 1))
    got = [tuple(r) for r in out.where("mz > 0 AND NOT isnan(mz)").collect()]
    by = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert len(got) == len(want) > 100 and all((a[0], a[3]) == (b[0], b[3]) and a[1:3] == pytest.approx(b[1:3], rel=1e-12) for a, b in zip(sorted(got, key=by), sorted(want, key=by)))
    assert sorted((r.intensity, r.n) for r in out.where("mz IS NULL OR mz < 0 OR isnan(mz)").collect()) == [(1.0, 1)] * 6 + [(3.0, 1)] * 3 + [(4.0, 1)] * 6
    assert "FlatMapGroupsInPandas [__bucket" in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("signed", [False, True])
def test_presearch_pairs_classes_of_equal_masses(spark, monkeypatch, signed):
    """Against all pairs by loops, with copies; only unlike precursors are joined, and quantiles hold in passes."""
    from peakloom.constants import PROTON

    rng = np.random.default_rng(9)
    masses = [1000.0, *(1000.0 * (1 + rng.integers(-60, 61, 25) * 1e-6))]
    few = [(float(m) / z + PROTON, z) for k, m in enumerate(masses) for z in ((2, 3) if k % 2 else (2,))] + [(500.0, 2), (900.0, 0)]
    rows = [(k, mz, z) for k, (mz, z) in enumerate((few * 6)[: 6 * len(few)])] + [(None, few[1][0], few[1][1])]
    own, made, real = spark.createDataFrame(rows, "id long, mz double, charge int"), [], calibration.tolerance_join
    monkeypatch.setattr(calibration, "tolerance_join", lambda a, b, *r, **k: made.append(a.count()) or real(a, b, *r, **k))
    got = calibration.presearch_errors(own, least=10, signed=signed).head()
    flat = [(k, mz * z - z * PROTON, z) for k, mz, z in rows]
    middle, errors = np.median([m for _, m, _ in flat]), []
    for i, a, z in flat:
        for j, b, y in flat:
            if z != y and b <= a + a * 50.0 / 1e6 and (b > a or (b == a and None not in (i, j) and j > i)):
                errors.append((b - a) * (-1 if signed and y < z else 1) / middle * 1e6)
    e = np.array(errors)
    apart = np.abs(e - np.median(e))
    kept = e[apart / (1.4826 * np.median(apart)) < 3]
    assert got.n_pairs == len(e) and made == [len({(mz * z - z * PROTON, z) for _, mz, z in rows})]
    want = (np.median(kept), np.std(kept), max(10.0, np.quantile(np.abs(kept), 0.95) + 5))
    assert tuple(got)[:3] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(windows, "EXACT_ROWS", 3)
    frame = spark.createDataFrame([(float(v), int(n)) for v, n in zip(rng.integers(0, 90, 60) ** 2, rng.integers(1, 9, 60))] + [(None, 3)], "v double, w long")
    each = np.concatenate([[r.v] * r.w for r in frame.where("v IS NOT NULL").collect()])
    assert windows.weighted_quantiles(frame, "v", "w", [0.0, 0.3, 0.5, 0.95, 1.0]) == pytest.approx(list(np.quantile(each, [0.0, 0.3, 0.5, 0.95, 1.0])))
    assert windows.weighted_quantiles(frame.limit(0), "v", "w", [0.5]) == [None]


@pytest.mark.parametrize("anneal", [False, True])
def test_copies_of_peaks_are_one_row_of_feature_finding(spark, monkeypatch, anneal):
    rng = np.random.default_rng(6)
    n = 300
    first = pd.DataFrame({"run_id": "r", "peak_id": np.arange(n), "scan": rng.integers(0, 3, n), "mz": rng.integers(40000, 40060, n) / 100, "intensity": rng.integers(1, 40, n) * 100.0, "rt_sec": rng.integers(0, 120, n) * 1.0})
    frame = pd.concat([first.assign(peak_id=first.peak_id + n * k) for k in range(5)], ignore_index=True)
    params = FeatureFinding(ppm=30.0, rt_tolerance=6.0, min_intensity=500.0, min_peaks=6, core_rt=4.0)
    made, real = [], features.islands
    monkeypatch.setattr(features, "islands", lambda rows, *r: made.append(rows.count()) or real(rows, *r))
    got = features.find_features(spark.createDataFrame(frame), params, anneal).toPandas().sort_values("seed_id")
    want = features.greedy(frame, params, anneal).sort_values("seed_id")
    assert len(want) > 20 and want.seed_id.tolist() == got.seed_id.tolist() and made == [len(first.drop_duplicates(["mz", "rt_sec", "scan"]))]
    assert np.allclose(want.drop(columns="run_id").to_numpy(float), got.drop(columns="run_id").to_numpy(float), atol=1e-4)


def test_proteins_count_their_peptides_without_an_exchange(spark):
    text = ["PEPTIDEKPEPTIDEKAAAAAAARPEPTIDEK", "PEPTIDEK" * 3, "KKRRPAAAAAAAK", "", None]
    for rows_ in (list(enumerate(text)) + [(None, text[0])], [(k % 3, s) for k, s in enumerate(text * 2)]):
        own = spark.createDataFrame(rows_, "protein_id long, sequence string")
        out = sequences.digest_proteins(own)[1]
        found = {(r.protein_id, r.peptide) for r in sequences.digest(own).collect()}
        want = [(i or 0, s is not None and len(s), sum(p == i for p, _ in found) if i is not None else 0) for i, s in rows_]
        assert sorted((r.protein_id or 0, r.length is not None and r.length, r.n_peptides) for r in out.collect()) == sorted(want)
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (len(rows_) > len(text) + 1)
