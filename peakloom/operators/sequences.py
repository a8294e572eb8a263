"""Digestion, peptide databases and theoretical fragments: row generators over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import H2O, ISOTOPE_SPACING, PROTON, STANDARD
from ..functions import decoys, mass


def digest(proteins: DataFrame, missed: int = 2, shortest: int = 7, longest: int = 35) -> DataFrame:
    """(protein_id, missed, position, peptide): tryptic peptides, duplicates kept.

    Cuts follow K or R unless P comes next; peptides with letters outside the twenty residues are left out.  A protein's
    pieces are one array, so peptides of any number of missed cleavages are joined slices of it."""
    pieces = F.filter(F.split("sequence", "(?<=[KR])(?!P)"), lambda x: x != "")
    cut = proteins.select("protein_id", pieces.alias("pieces"))
    starts = cut.select("protein_id", "pieces", F.explode(F.sequence(F.lit(0), F.lit(missed))).alias("missed"))
    n = F.size("pieces") - F.col("missed")
    starts = starts.where(n > 0).select("protein_id", "pieces", "missed", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("pieces", i, F.col("missed") + 1), ""))).alias("position", "peptide"))
    length = F.char_length("peptide")
    return starts.where((length >= shortest) & (length <= longest) & F.col("peptide").rlike(f"^[{STANDARD}]+$")).select("protein_id", "missed", "position", "peptide")


def _of_rows(proteins: DataFrame, missed: int, shortest: int, longest: int) -> DataFrame:
    """``proteins`` with ``__peptides``: an array for each number of missed cleavages, of what ``digest`` has in rows."""
    pieces = F.filter(F.split("sequence", "(?<=[KR])(?!P)"), lambda x: x != "")
    cut = proteins.withColumn("__pieces", pieces).withColumn("__n", F.size("__pieces"))
    joined = lambda m: F.transform(F.sequence(F.lit(1), F.col("__n") - m), lambda i: F.array_join(F.slice("__pieces", i, m + 1), ""))
    fits = lambda x: F.char_length(x).between(shortest, longest) & x.rlike(f"^[{STANDARD}]+$")
    each = [F.when(F.col("__n") > m, F.filter(joined(m), fits)).otherwise(F.array().cast("array<string>")) for m in range(missed + 1)]
    return cut.withColumn("__peptides", F.array(*each)).drop("__pieces", "__n")


def _ids_repeat(proteins: DataFrame) -> bool:
    return bool(proteins.where("protein_id IS NOT NULL").groupBy("protein_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def peptides(digested: DataFrame) -> DataFrame:
    """(sequence, proteins array, n_occurrences): distinct peptides and the proteins that have them."""
    own = digested.groupBy(F.col("peptide").alias("sequence"), "protein_id").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("sequence").agg(F.array_sort(F.collect_list("protein_id")).alias("proteins"), F.sum("n").alias("n_occurrences"))


def digest_proteins(proteins: DataFrame, missed: int = 2, shortest: int = 7, longest: int = 35) -> tuple[DataFrame, DataFrame]:
    """(peptides, proteins): ``peptides`` of the digest, and (protein_id, description, gene, length, n_peptides) of every
    protein; n_peptides counts distinct peptides.

    ``proteins``: protein_id, sequence and maybe description; a missing description is empty, and so is its gene.  Distinct
    peptides are counted inside a row; only where several rows have one id (looked for first, on the ids alone) are they
    compared between rows."""
    found = digest(proteins, missed, shortest, longest)
    text = F.coalesce("description", F.lit("")) if "description" in proteins.columns else F.lit("")
    if not _ids_repeat(proteins):
        n = F.when(F.col("protein_id").isNull(), 0).otherwise(F.coalesce(F.size(F.array_distinct(F.flatten("__peptides"))), F.lit(0)))
        own = _of_rows(proteins, missed, shortest, longest)
        return peptides(found), own.select("protein_id", text.alias("description"), gene_name(text).alias("gene"), F.char_length("sequence").alias("length"), n.cast("long").alias("n_peptides"))
    n = found.select("protein_id", "peptide").distinct().groupBy("protein_id").agg(F.count(F.lit(1)).alias("n_peptides"))
    facts = proteins.select("protein_id", text.alias("description"), gene_name(text).alias("gene"), F.char_length("sequence").alias("length"))
    return peptides(found), facts.join(n, "protein_id", "left").fillna(0, ["n_peptides"])


def gene_name(description: Column) -> Column:
    return F.regexp_extract(description, "GN=([^ ]*)", 1)


def mass_index(sequences: DataFrame) -> DataFrame:
    """Adds sequence_il (I as L), length and neutral_mass: the columns of a peptide database."""
    il = F.translate("sequence", "I", "L")
    return sequences.withColumns({"sequence_il": il, "length": F.char_length("sequence"), "neutral_mass": mass.neutral_mass(F.col("sequence"))})


def target_decoy_database(proteins: DataFrame, missed: int = 2, shortest: int = 7, longest: int = 35, method: str = "diann") -> DataFrame:
    """Distinct tryptic peptides and their decoys with masses and lengths.

    A mass is computed once for each target; a decoy of the same residues carries it along."""
    found = digest(proteins, missed, shortest, longest).select(F.col("peptide").alias("sequence"))
    if method in decoys.CHANGES_MASS:
        return mass_index(decoys.append_decoys(found, method))
    weighed = found.distinct().withColumn("neutral_mass", mass.neutral_mass(F.col("sequence")))
    return decoys.append_decoys(weighed, method, carry="neutral_mass").withColumns({"sequence_il": F.translate("sequence", "I", "L"), "length": F.char_length("sequence")})


def fragments(sequences: DataFrame, charges: tuple[int, ...] = (1, 2), types: tuple[str, ...] = ("b", "y"), modifications: Column | None = None) -> DataFrame:
    """Adds (ion_type 0 b / 1 y, position, charge, mz float) rows: prefix and suffix masses at each charge up to the position.

    ``modifications``: an array of (position from 0, delta); one at k adds to b from k + 1 residues on, and to y where it
    is inside the suffix."""
    own = mass.residue_masses(F.col("sequence"))
    if modifications is not None:
        own = F.transform(own, lambda m, i: m + F.aggregate(F.filter(modifications, lambda x: x["position"] == i), F.lit(0.0), lambda a, x: a + x["delta"]))
    rows = sequences.withColumn("__masses", own).withColumn("__n", F.size("__masses")).where("__n > 1")
    rows = rows.withColumn("__prefix", F.expr("aggregate(__masses, array(cast(0 as double)), (a, m) -> array_append(a, element_at(a, -1) + m))"))
    ions = [F.struct(F.lit(t).cast("short").alias("ion_type"), F.lit(z).cast("short").alias("charge")) for name, t in (("b", 0), ("y", 1)) if name in types for z in charges]
    rows = rows.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("__n") - 1))).withColumn("__ion", F.explode(F.array(*ions)))
    z, p = F.col("__ion.charge").cast("int"), F.col("position")
    prefix, whole = F.element_at("__prefix", p + 1), F.element_at("__prefix", F.col("__n") + 1)
    neutral = F.when(F.col("__ion.ion_type") == 0, prefix).otherwise(whole - F.element_at("__prefix", F.col("__n") - p + 1) + H2O)
    mz = ((neutral + z * PROTON) / z).cast("float")
    return rows.where(z <= p).select(*sequences.columns, F.col("__ion.ion_type").alias("ion_type"), F.col("position").cast("short").alias("position"), F.col("__ion.charge").alias("charge"), mz.alias("mz"))


def isotope_ladder(mz: Column, charge: Column, n: int = 5) -> Column:
    """m/z of the first n isotope peaks; charges below 1 count as 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: mz + i * ISOTOPE_SPACING / F.greatest(charge, F.lit(1)))
