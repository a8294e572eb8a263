"""Stepwise quality scores of features, isotope groups and consolidated features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(rules: list[tuple[Column, float]]) -> Column:
    """The value of the first rule that holds, else 0."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(0.0))


def base_score(mz_std_ppm: Column, fwhm: Column, n_peaks: Column, n_scans: Column, intensity: Column, threshold: float = 500.0) -> Column:
    """0 to 100 from mass spread, peak width, numbers of peaks and scans, and intensity over the threshold."""
    spread = _steps([(mz_std_ppm < 1, 30.0), (mz_std_ppm < 2, 25.0), (mz_std_ppm < 5, 20.0), (mz_std_ppm < 10, 10.0)])
    width = _steps([((fwhm >= 1) & (fwhm <= 10), 30.0), ((fwhm >= 0.5) & (fwhm <= 20), 20.0), (fwhm > 0, 10.0)])
    peaks = _steps([(n_peaks >= 10, 20.0), (n_peaks >= 5, 15.0), (n_peaks >= 3, 10.0)])
    scans = _steps([(n_scans >= 5, 10.0), (n_scans >= 3, 5.0)])
    if threshold > 0:
        strong = _steps([(intensity / threshold > 100, 10.0), (intensity / threshold > 10, 7.0), (intensity / threshold > 1, 3.0)])
    else:
        strong = _steps([(intensity > 10000, 10.0), (intensity > 1000, 7.0), (intensity > 100, 3.0)])
    return F.least(spread + width + peaks + scans + strong, F.lit(100.0))


def isotope_bonus(has_m1: Column, m1_error_ppm: Column, has_m2: Column) -> Column:
    error = F.abs(m1_error_ppm)
    close = _steps([(error < 1, 5.0), (error < 2, 3.0), (error < 5, 1.0)])
    return F.when(has_m1, 10.0 + close).otherwise(0.0) + F.when(has_m2, 5.0).otherwise(0.0)


def group_score(base: Column, bonus: Column) -> Column:
    return F.least((base + bonus) / 120 * 100, F.lit(100.0))


def charge_bonus(n_charges: Column, mass_rsd_ppm: Column) -> Column:
    return F.when(n_charges >= 2, _steps([(mass_rsd_ppm < 2, 10.0), (mass_rsd_ppm < 5, 5.0), (mass_rsd_ppm < 10, 2.0)])).otherwise(0.0)


def consolidated_score(base: Column, bonus: Column, charges: Column) -> Column:
    return F.least((base + bonus + charges) / 130 * 100, F.lit(100.0))


def fragment_isotope_weight(fraction: Column) -> Column:
    return _steps([(fraction >= 0.5, 0.15), (fraction >= 0.3, 0.05)])


def filter_by_quality(features: DataFrame, score: str = "quality", least: float = 70.0) -> DataFrame:
    return features.where(F.col(score) >= least)
