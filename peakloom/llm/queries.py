"""One thin query for each corpus operator, over its whole table, and the SQL that states its result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, merkle, mixing, quality, simhash, substring, toxicity, warc
from .common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op3_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_license_scan, op3_merkle_fingerprint, op4_benchmark_decontamination, op5_chat_formatting,
        op6_warc_archive, op7_source_mixing, op8_substring_dedup, op9_quality, op10_toxicity,
    )
}
#: Absent: op1 (XXH64 and links of links aren't SQL's), op5, op9 and op10 (trained models), op7 (a balanced sample is one of many).
ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.SQL,
    "op3_merkle_fingerprint": merkle.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op6_warc_archive": warc.SQL,
    "op8_substring_dedup": substring.SQL,
}
