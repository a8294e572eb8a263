"""Bounded samples of labelled rows, from which models are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, hash_share, text_bytes

#: Labelled documents that a classifier is fitted on at most, and the bytes of text after which no further one is taken.
SAMPLE_ROWS, SAMPLE_BYTES = 3500, 8 << 20


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def first_rows(rows: DataFrame, order: list, n_rows: int, n_bytes: int, text: str) -> list:
    """The first ``n_rows`` rows in ``order``, or fewer: none after ``n_bytes`` of ``text`` are reached.

    The bound is on the total, so a row's own length never decides whether it may be taken.  The rows are picked in one
    task's bounded queue and counted in one small window; the driver gets only those that are returned."""
    few = checkpoint(rows.orderBy(*order).limit(n_rows))
    before = F.coalesce(F.sum(F.octet_length(text)).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("__before", before).where(F.col("__before") < n_bytes).drop("__before").orderBy(*order).collect()


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> list[tuple[bytes, int]]:
    """(text, label 0 or 1) of labelled documents where ``learn`` holds, by a hash of the id up to the two bounds above.

    Labels that repeat an id count as their largest; null ids and labels are left out, and so are null and empty texts.
    The rows are ordered, so reruns fit the same model."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(label).cast("int").alias("label"))
    # more ids than are used, for documents that are missing; a share of the hash's range, bounded, so it may be broadcast
    chosen = hash_share(known, ["labelled"], 3 * SAMPLE_ROWS, known.count()).orderBy(F.xxhash64("labelled"), "labelled").limit(2 * SAMPLE_ROWS)
    rows = docs.select("doc_id", text_bytes().alias("text")).where(F.octet_length("text") > 0)
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("labelled", "text", "label")
    order = [F.xxhash64("labelled"), "labelled", F.xxhash64("text")]
    return [(bytes(r["text"]), int(r["label"] > 0)) for r in first_rows(rows, order, SAMPLE_ROWS, SAMPLE_BYTES, "text")]
