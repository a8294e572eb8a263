"""Readers of FASTA, peptide lists and prediction libraries, and a content-keyed index cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MASSES
from ..functions import decoys
from ..operators.sequences import gene_name, mass_index, target_decoy_database


def header_id(header: Column) -> Column:
    """The second field between bars if there are any, else the first word."""
    return F.when(header.contains("|"), F.split(header, "\\|")[1]).otherwise(F.split(header, "\\s+")[0])


def read_fasta(spark: SparkSession, paths: str | list[str], min_length: int = 0) -> DataFrame:
    """(protein_id, sequence, description, gene_name) of every record of one or more FASTA files.

    Records are split by Spark's text source at line breaks before ">", so a file of any size is read in parallel."""
    raw = spark.read.option("lineSep", "\n>").text(paths)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = raw.select(F.substring_index(text, "\n", 1).alias("description"), F.regexp_replace(F.substring(text, F.lit(1), F.char_length(text)), "^[^\n]*\n?", "").alias("body"))
    own = parts.select(header_id(F.col("description")).alias("protein_id"), F.upper(F.regexp_replace("body", "\\s", "")).alias("sequence"), "description")
    return own.where((F.char_length("description") > 0) & (F.char_length("sequence") >= min_length)).withColumn("gene_name", gene_name(F.col("description")))


def from_list(spark: SparkSession, peptides: list[str], with_decoys: str | None = None) -> DataFrame:
    own = spark.createDataFrame([(p,) for p in peptides], "sequence string")
    return mass_index(decoys.append_decoys(own, with_decoys) if with_decoys else own)


def from_tsv(spark: SparkSession, path: str, column: str = "sequence", with_decoys: str | None = None) -> DataFrame:
    """Peptides of a tab-separated file with a header; raises ValueError if it has no such column."""
    own = spark.read.csv(path, sep="\t", header=True)
    if column not in own.columns:
        raise ValueError(f"no column {column!r} in {path}")
    own = own.select(F.col(column).alias("sequence")).where("sequence IS NOT NULL")
    return mass_index(decoys.append_decoys(own, with_decoys) if with_decoys else own)


def from_fasta(spark: SparkSession, paths: str | list[str], enzyme: str = "trypsin", missed: int = 2, shortest: int = 7, longest: int = 35, method: str = "diann") -> DataFrame:
    if enzyme != "trypsin":
        raise NotImplementedError(f"enzyme {enzyme!r}; only trypsin")
    return target_decoy_database(read_fasta(spark, paths), missed, shortest, longest, method)


def unpivot_predictions(wide: DataFrame, least: float = 0.01) -> DataFrame:
    """Rows (sequence, charge, position, b_z1, b_z2, y_z1, y_z2) -> (sequence, charge, ion_type, position, frag_charge,
    intensity) of intensity over ``least``; modification tags in the sequence go."""
    plain = F.regexp_replace("sequence", r"\[[^\]]*\]|\([^)]*\)", "")
    stack = "stack(4, 'b', 1, b_z1, 'b', 2, b_z2, 'y', 1, y_z1, 'y', 2, y_z2) AS (ion_type, frag_charge, intensity)"
    return wide.withColumn("sequence", plain).selectExpr("sequence", "charge", "position", stack).where(F.col("intensity") > least)


def lookup_predictions(psms: DataFrame, library: DataFrame) -> DataFrame:
    """Predicted fragments of each (psm_id, sequence, charge): an equi-join."""
    return psms.select("psm_id", "sequence", "charge").join(library, ["sequence", "charge"])


def residue_hash(masses: dict[str, float] = MASSES) -> str:
    """Tells one table of residue masses from another."""
    return hashlib.sha256(json.dumps(sorted(masses.items())).encode()).hexdigest()[:12]


def cache_key(params: dict, sources: list[tuple[str, int, int]], masses: dict[str, float] = MASSES) -> str:
    return hashlib.sha256(json.dumps([params, sorted(sources), residue_hash(masses)], sort_keys=True).encode()).hexdigest()[:16]


def cached_index(spark: SparkSession, paths: list[str], folder: str, **params) -> DataFrame:
    """The target-decoy index of FASTA files, kept as Parquet below ``folder`` under a key of
    parameters, residue masses, sizes and times."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.unix_millis("modificationTime").alias("t")).collect()
    target = f"{folder}/{cache_key(params, [(r['path'], r['length'], r['t']) for r in files])}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        made = from_fasta(spark, paths, **params)
        made.repartitionByRange("neutral_mass").sortWithinPartitions("neutral_mass").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
