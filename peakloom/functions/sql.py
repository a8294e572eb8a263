"""The column functions as SQL functions of a session, so that queries in text can call them.

They are expressions, not Python: the optimiser puts each call's expression into the query's plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import H2O, MASSES, PROTON, STANDARD

_MASS = " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) * {m!r}D" for c, m in MASSES.items())
_TABLE = "RETURNS TABLE(missed INT, position INT, peptide STRING) RETURN"
FUNCTIONS = {
    "ppm_error": "(observed DOUBLE, theoretical DOUBLE) RETURNS DOUBLE RETURN (observed - theoretical) / theoretical * 1e6D",
    "mass_from_mz": f"(mz DOUBLE, charge INT) RETURNS DOUBLE RETURN mz * charge - charge * {PROTON!r}D",
    "precursor_mz": f"(mass DOUBLE, charge INT) RETURNS DOUBLE RETURN (mass + charge * {PROTON!r}D) / charge",
    "correct_mz": "(mz DOUBLE, ppm DOUBLE) RETURNS DOUBLE RETURN mz / (1 + ppm / 1e6D)",
    "mz_log_bin": "(mz DOUBLE, ppm DOUBLE) RETURNS BIGINT RETURN CASE WHEN mz > 0 THEN CAST(floor(ln(mz) / ln(1 + ppm / 1e6D)) AS BIGINT) ELSE 0 END",
    "peptide_mass": f"(s STRING) RETURNS DOUBLE RETURN {_MASS} + {H2O!r}D",
    "diann_decoy": "(s STRING) RETURNS STRING RETURN CASE WHEN length(s) <= 2 THEN s ELSE concat(left(s, 1), reverse(substring(s, 2, length(s) - 2)), right(s, 1)) END",
    "tryptic_peptides": f"""(seq STRING, most INT) {_TABLE}
      SELECT m, CAST(i - 1 AS INT), array_join(slice(c, i, m + 1), '') FROM (SELECT filter(split(seq, '(?<=[KR])(?!P)'), x -> x <> '') AS c, most AS k), LATERAL explode(sequence(0, k)) AS a(m), LATERAL explode(sequence(1, size(c))) AS b(i)
      WHERE i + m <= size(c) AND array_join(slice(c, i, m + 1), '') RLIKE '^[{STANDARD}]+$'""",
}


def register(spark: SparkSession) -> None:
    """Makes ``FUNCTIONS`` temporary functions of the session; a session may be registered more than once."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
