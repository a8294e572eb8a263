"""Column functions on sequences, masses and m/z; all of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import H2O, MASSES, MODIFICATIONS, PROTON, SUBSTITUTES


def clean(sequence: Column) -> Column:
    """Letters outside the twenty residues become the residue that stands for them."""
    return F.translate(sequence, "".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def codes(sequence: Column) -> Column:
    """Code points of the residues."""
    return F.transform(letters(sequence), F.ascii)


def _table(masses: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in masses.items() for x in pair])


def residue_masses(sequence: Column, masses: dict[str, float] = MASSES) -> Column:
    """Mass of each residue; unknown letters weigh nothing."""
    table = _table(masses)
    return F.transform(letters(sequence), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def neutral_mass(sequence: Column, masses: dict[str, float] = MASSES) -> Column:
    """Sum of residue masses and water.

    Counted by letter rather than summed by position: n(letter) * mass over the table, which needs no array and stays in
    generated code."""
    n = F.char_length(sequence)
    terms = [(n - F.char_length(F.replace(sequence, F.lit(c), F.lit("")))) * F.lit(m) for c, m in masses.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out + H2O


def fixed_modification(masses: dict[str, float], residue: str, shift: float) -> dict[str, float]:
    return masses | {residue: masses[residue] + shift}


def parse_modifications(names: Column, sites: Column) -> Column:
    """"Oxidation@M;Acetyl@K", "3;7" -> array of (name, position from 0); entries without "@" or a whole number go."""
    strip = lambda c: F.regexp_replace(c, r"^b'|'$", "")
    pairs = F.arrays_zip(F.split(strip(names), ";").alias("name"), F.split(strip(sites), ";").alias("site"))
    good = F.filter(pairs, lambda p: p["name"].contains("@") & F.coalesce(p["site"], F.lit("")).rlike("^[0-9]+$"))
    return F.transform(good, lambda p: F.struct(F.split(p["name"], "@")[0].alias("name"), (p["site"].cast("int") - 1).alias("position")))


def shifts(modifications: Column) -> Column:
    """(name, position) array -> (position, delta) array; unknown names shift nothing."""
    table = _table(MODIFICATIONS)
    return F.transform(modifications, lambda m: F.struct(m["position"].alias("position"), F.coalesce(F.try_element_at(table, m["name"]), F.lit(0.0)).alias("delta")))


def modified_mass(sequence: Column, modifications: Column) -> Column:
    return neutral_mass(sequence) + F.aggregate(shifts(modifications), F.lit(0.0), lambda a, m: a + m["delta"])


def precursor_mz(mass: Column, charge: Column | int) -> Column:
    z = F.lit(charge) if isinstance(charge, int) else charge
    return (mass + z * PROTON) / z


def mass_from_mz(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * PROTON


def ppm_error(observed: Column, theoretical: Column) -> Column:
    return (observed - theoretical) / theoretical * 1e6


def spacing_error(observed: Column, expected: Column | float, mz: Column) -> Column:
    return (observed - expected) / mz * 1e6


def complementary_mz(mass: Column, fragment_mz: Column, charge: Column, complement_charge: Column | int) -> Column:
    zc = F.lit(complement_charge) if isinstance(complement_charge, int) else complement_charge
    return (mass - mass_from_mz(fragment_mz, charge) + zc * PROTON) / zc


def bin_width(ppm: float) -> float:
    return math.log(1 + ppm / 1e6)


def log_bin(mz: Column, ppm: float) -> Column:
    """floor(ln(m) / ln(1 + ppm)); 0 for nothing above zero."""
    return F.when(mz > 0, F.floor(F.ln(mz) / bin_width(ppm))).otherwise(F.lit(0)).cast("long")


def log_factorial(n: Column) -> Column:
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i)))


def correct_mz(mz: Column, ppm: Column) -> Column:
    return mz / (1 + ppm / 1e6)
