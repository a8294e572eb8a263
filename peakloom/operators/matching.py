"""Fragment matching: records of theoretical fragments found among a spectrum's peaks or features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mass import mass_from_mz, ppm_error
from .joins import match


def fragment_matches(fragments: DataFrame, peaks: DataFrame, key: list[str], ppm: float = 10.0, least_intensity: float = 0.0, unmatched: bool = False, unit: str = "ppm") -> DataFrame:
    """(key, peak_id, observed_mz, observed_intensity, mass_error_ppm): each fragment's nearest peak, if that peak is
    intense enough; a weaker nearest peak isn't replaced by another.

    fragments: key columns and target_mz; peaks: peak_id, mz, intensity.  ``unmatched``: fragments without a match stay,
    with peak_id -1 and nulls.  ``unit``: the tolerance's, "ppm" or "Da"."""
    found = match(fragments, peaks, ppm, "nearest", key, unit=unit).where(F.col("intensity") >= least_intensity)
    out = found.select(*key, "peak_id", F.col("mz").alias("observed_mz"), F.col("intensity").alias("observed_intensity"), ppm_error(F.col("mz"), F.col("target_mz")).alias("mass_error_ppm"))
    if not unmatched:
        return out
    return fragments.select(*key).join(out, key, "left").withColumn("peak_id", F.coalesce("peak_id", F.lit(-1).cast(dict(out.dtypes)["peak_id"])))


def coeluting_matches(
    fragments: DataFrame, features: DataFrame, key: list[str], precursor_rt: float | Column, ppm: float = 10.0, rt_tolerance: float = 3.0, least_intensity: float = 0.0, mirror: bool = True
) -> DataFrame:
    """(key, peak_id, observed_mz, observed_intensity, mass_shift, rt_delta): the nearest feature of each fragment, if it
    elutes within ``rt_tolerance`` seconds of the precursor and is intense enough.

    fragments: key, target_mz, charge; features: peak_id, mz, intensity, rt_sec.  ``mass_shift`` is the observed neutral
    mass at the fragment's charge, from which modifications are told by the ion on the other side (``mirror``), else 0."""
    at = F.lit(precursor_rt) if isinstance(precursor_rt, (int, float)) else precursor_rt
    found = match(fragments, features, ppm, "nearest", key).withColumn("rt_delta", F.abs(F.col("rt_sec") - at))
    found = found.where((F.col("rt_delta") <= rt_tolerance) & (F.col("intensity") >= least_intensity))
    shift = mass_from_mz(F.col("mz"), F.col("charge")) if mirror else F.lit(0.0)
    return found.select(*key, "peak_id", F.col("mz").alias("observed_mz"), F.col("intensity").alias("observed_intensity"), shift.alias("mass_shift"), "rt_delta")


def candidate_matches(fragments: DataFrame, peaks: DataFrame, candidate: str, fragment: str, rt: float | Column, rt_tolerance: float, ppm: float = 10.0, most: int = 50) -> DataFrame:
    """(candidate, fragment, peak_id, observed_mz, observed_intensity, mass_error_ppm, rt_diff): of each candidate's
    fragments in order the first ``most`` whose leftmost peak in the window elutes in time.

    fragments: candidate, fragment, target_mz; peaks: peak_id, mz, intensity, rt_sec.  The limit is the operator's own; a
    candidate has no more rows than fragments."""
    at = F.lit(rt) if isinstance(rt, (int, float)) else rt
    found = match(fragments, peaks, ppm, "leftmost", [candidate, fragment]).withColumn("rt_diff", F.abs(F.col("rt_sec") - at)).where(F.col("rt_diff") <= rt_tolerance)
    found = found.withColumn("__n", F.row_number().over(W.partitionBy(candidate).orderBy(fragment))).where(F.col("__n") <= most)
    return found.select(candidate, fragment, "peak_id", F.col("mz").alias("observed_mz"), F.col("intensity").alias("observed_intensity"), ppm_error(F.col("mz"), F.col("target_mz")).alias("mass_error_ppm"), "rt_diff")


def normalized(rows: DataFrame, keys: list[str], value: str = "intensity", out: str = "normalized") -> DataFrame:
    """Adds the value over its group's maximum; groups whose maximum is under 1e-9 stay as they are."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("__top"))
    return rows.join(top, keys).withColumn(out, F.when(F.col("__top") < 1e-9, F.col(value)).otherwise(F.col(value) / F.col("__top"))).drop("__top")


def score_matches(predicted: DataFrame, theoretical: DataFrame, peaks: DataFrame, tolerance: float = 0.02, least: float = 0.01) -> DataFrame:
    """(psm_id, ion_type, position, frag_charge, predicted, observed): predicted fragments that theory has as well, with the
    intensity of the peak nearest to the theoretical m/z (null: none within ``tolerance`` Da).

    predicted: psm_id, ion_type, position, frag_charge, intensity; weaker ones than ``least`` are left out.  theoretical:
    psm_id, ion_type, position, frag_charge, target_mz.  peaks: psm_id, peak_id, mz, intensity.  ``psm.intensity_correlation``
    and ``psm.match_statistics`` take the rows from here; what they count as predicted is what theory has."""
    key = ["psm_id", "ion_type", "position", "frag_charge"]
    own = predicted.where(F.col("intensity") >= least).select(*key, F.col("intensity").alias("predicted")).join(theoretical.select(*key, "target_mz"), key)
    near = peaks.select(F.col("psm_id").alias("__of"), "peak_id", "mz", F.col("intensity").alias("observed"))
    found = match(own, near, tolerance, "nearest", key, same={"psm_id": "__of"}, unit="Da", intensity="observed").select(*key, "observed")
    return own.select(*key, "predicted").join(found, key, "left")
