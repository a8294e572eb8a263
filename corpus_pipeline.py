"""The corpus pipeline: five stages, each one operator, run over ``documents`` in order.

Every stage takes all rows that its predecessor kept and returns the columns of documents; the last adds how often the mix
takes a document.  ``run`` writes each stage's rows as Parquet in the shared checkpoint folder and reads them back, so that
a lost executor repeats one stage's tasks and not the stages before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import decontaminate, mixing, simhash, substring, toxicity
from peakloom.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.representatives(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages of 50 words or more that a smaller document has go; every document stays."""
    return substring.cut(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; the hit words of a single item are cut out."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix),
]
#: Fingerprint links, trained models and balanced sampling can't be stated in SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
