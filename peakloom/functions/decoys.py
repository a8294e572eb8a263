"""Decoy sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mass import neutral_mass


def reverse(s: Column) -> Column:
    return F.reverse(s)


def kr_swap(s: Column) -> Column:
    """Reversed, K and R exchanged."""
    return F.translate(F.reverse(s), "KR", "RK")


def pseudo_reverse(s: Column) -> Column:
    """All but the last residue reversed; two residues or fewer stay."""
    n = F.char_length(s)
    return F.when(n <= 2, s).otherwise(F.concat(F.reverse(s.substr(F.lit(1), n - 1)), s.substr(n, F.lit(1))))


def diann(s: Column) -> Column:
    """Both termini kept, the inside reversed; two residues or fewer stay."""
    n = F.char_length(s)
    return F.when(n <= 2, s).otherwise(F.concat(s.substr(F.lit(1), F.lit(1)), F.reverse(s.substr(F.lit(2), n - 2)), s.substr(n, F.lit(1))))


def shuffled(s: Column, seed: int = 42) -> Column:
    """A reproducible shuffle that keeps both termini: inner residues ordered by a hash of residue, place and sequence."""
    n = F.char_length(s)
    inner = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: F.struct(F.xxhash64(F.lit(seed), s, i).alias("h"), s.substr(i, F.lit(1)).alias("c")))
    mixed = F.array_join(F.transform(F.array_sort(inner), lambda x: x["c"]), "")
    return F.when(n <= 3, s).otherwise(F.concat(s.substr(F.lit(1), F.lit(1)), mixed, s.substr(n, F.lit(1))))


METHODS = {"diann": diann, "pseudo_reverse": pseudo_reverse, "reverse": reverse, "kr_swap": kr_swap, "shuffle": shuffled}
#: Methods whose decoys have other residues than their targets.
CHANGES_MASS = ("kr_swap",)


def decoy(s: Column, method: str = "diann") -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown decoy method {method!r}; one of {sorted(METHODS)}")
    return METHODS[method](s)


def same_mass(target: Column, other: Column, tolerance: float = 0.001) -> Column:
    return F.abs(neutral_mass(target) - neutral_mass(other)) <= tolerance


def append_decoys(targets: DataFrame, method: str = "diann", column: str = "sequence", carry: str | None = None) -> DataFrame:
    """Distinct targets and their decoys, (sequence, is_decoy, accession); a decoy that is a target is left out.

    Both come from one pass over the targets and meet in one aggregation, which combines repeats before the exchange.
    ``carry``: a column that a decoy has from its target."""
    own, entry = F.col(column), lambda s, d: F.struct(s.alias("sequence"), F.lit(d).alias("is_decoy"), *([F.col(carry)] if carry else []))
    both = targets.select(F.explode(F.array(entry(own, False), entry(decoy(own, method), True))).alias("x")).select("x.*")
    union = both.groupBy("sequence").agg(F.min("is_decoy").alias("is_decoy"), *([F.min(carry).alias(carry)] if carry else []))
    return union.withColumn("accession", F.when(F.col("is_decoy"), F.concat(F.lit("DECOY_"), "sequence")).otherwise(F.col("sequence")))
