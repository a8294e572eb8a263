"""Helpers shared by the corpus operators: tables, checkpoints, byte-level words and bounded chunks.

Text crosses to Python as UTF-8 bytes (a ``binary`` column), never as ``str``: ASCII-only lower-casing is then
``bytes.lower`` and the word rule ``[^\\x20\\x09-\\x0D]+`` is exactly ``bytes.split``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one chunk of a Python stage holds, unless a single text is longer.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where none is set, a folder of the warehouse, which a cluster shares;
    a temporary one only if driver and executors are one local process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        own = tempfile.mkdtemp(prefix="peakloom-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_peakloom"
        context.setCheckpointDir(configured or own)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder: smaller than a checkpoint, but typed columns only."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_share(rows: DataFrame, keys: list[str], wanted: int, total: int, seed: int = 29) -> DataFrame:
    """Rows whose keys' hash lies in the share ``wanted / total`` of its range: all rows of a key or none, without a sort."""
    if total <= wanted:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 32)) < int((1 << 32) * wanted / total))


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, hot_rows: int = 20_000) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key, with ``n``, the number of rows that have it) on ``keys``, without ``n``.

    Keys that hold more than 1 / ``hot_rows`` of all ``total`` rows are ``hot_rows`` at most: their facts are broadcast, so
    rows of hot keys stay where they are.  All others meet in a shuffle, where no key has more rows than that."""
    hot = F.col("n") * hot_rows > total
    few = F.broadcast(facts.where(hot).drop("n"))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(facts.where(~hot).drop("n"), keys))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives memory that earlier work freed back to the system: a worker lives on for other tasks of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column``, one row at least."""
    release()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.array([len(x) if x is not None else 0 for x in _views(values)], dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(sizes[stop - 1])
    release()


def _views(values: pa.Array) -> Iterator[memoryview | None]:
    for x in values:
        yield x.as_buffer() and memoryview(x.as_buffer()) if x.is_valid else None


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordNames(dict):
    """XXH64 of each word, kept while fewer than ``limit`` words are held."""

    def __init__(self, seed: int, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit names (vectorised)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
