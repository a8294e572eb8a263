"""Dictionary-compressed WARC archives.

An archive is a run of Zstandard frames: first a skippable frame (magic 0x184D2A5D) with a dictionary built from the
archive's own records, then one frame for each record.  Spark's text sink writes the files, so any Hadoop file system
does and a lost executor's task is repeated whole: each row is one frame, and the line separator is an empty skippable
frame, whose eight bytes are ASCII and which every reader of Zstandard passes over.  A file is one archive: it ends after
``ARCHIVE_ROWS`` frames or ``ARCHIVE_BYTES`` of records, whichever comes first.  As the sink counts rows, an archive that
bytes end is filled up with empty frames, eight bytes each.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shared_folder, text_bytes

#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: Frames of a file, its dictionary's included, and bytes of records after which an archive ends.
ARCHIVE_ROWS, ARCHIVE_BYTES = 4096, 32 << 20
#: A dictionary is built from so many of an archive's records at most, so many bytes of each, and has so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 4096, 16_384
LEVEL = 3

DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, b"P*M\x18\x00\x00\x00\x00"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on samples spread evenly over the records; their raw bytes where they are too few to train on."""
    step = max(1, -(-len(records) // SAMPLES))
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(row: dict) -> bytes:
    """A WARC/1.1 record.  A revisit has no block; its headers keep the full payload's digest and length."""
    revisit = row["refers_to"] is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((row['page_id'], row['url'], row['payload_digest'])).encode()).digest()[:16])}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((row["url"] or "").split())),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Page-ID", "" if row["page_id"] is None else str(row["page_id"])),
        ("X-Payload-Length", str(len(row["payload"]))),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(row["refers_to"]))]
    body = b"" if revisit else row["payload"]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _frames(batches: Iterator[pa.RecordBatch], archive_rows: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of a task, one after the other: a dictionary frame, a frame for each record, and empty ones to fill up."""
    waiting: list[bytes] = []

    def archive(fill: bool) -> pa.RecordBatch:
        shared = dictionary(waiting)
        content = shared.as_bytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        rows = [struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content, *map(packer.compress, waiting)]
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows + [b""] * (fill * (archive_rows - len(rows))), pa.binary())], ["value"])

    size = 0
    for part in chunks(batches, "payload"):
        for row in part.to_pylist():
            waiting.append(record(row))
            size += len(waiting[-1])
            if len(waiting) == archive_rows - 1 or size >= archive_bytes:
                yield archive(True)
                size = 0
    if waiting:
        yield archive(False)


def write(pages: DataFrame, path: str, archive_rows: int = ARCHIVE_ROWS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, payload, payload_digest, refers_to) as files of the folder ``path``.

    A task holds one archive's records at most, plus the payload that goes beyond its bound; a payload may be as large as
    a binary value of Arrow, 2 GB.  An empty table leaves a folder without records."""
    rows = pages.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(lambda batches: _frames(batches, archive_rows, archive_bytes), "value binary")
    sink = rows.select(F.col("value").cast("string").alias("value")).write.mode("errorifexists")
    sink.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", archive_rows).option("compression", "none").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    place, unpacker = 0, None
    while place < len(archive):
        magic, size = struct.unpack_from("<II", archive, place)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                content = archive[place + 8 : place + 8 + size]
                trained = content[:4] == b"\x37\xa4\x30\xec"
                kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
            place += 8 + size
            continue
        worker = unpacker.decompressobj()
        data = worker.decompress(archive[place : place + (1 << 16)])
        fed = min(len(archive), place + (1 << 16))
        while not worker.eof:
            data += worker.decompress(archive[fed : fed + (1 << 20)])
            fed = min(len(archive), fed + (1 << 20))
        place = fed - len(worker.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


_READ = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in parse(content.as_py()):
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"payload of page {head['X-Page-ID']} doesn't have its digest")
                rows.append((head["X-Page-ID"] or None, head["WARC-Target-URI"], kind, digest, int(head["X-Payload-Length"]), head.get("X-Refers-To-Page"), block if kind == "response" else None))
                size += len(block)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _READ.split(", ")])


def read(spark, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of each record below ``path``.

    Digests of responses are checked against their payloads; a revisit's payload is null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_records, _READ)
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is the page whose response a record revisits.

    Of equal payloads of ``REVISIT_BYTES`` bytes or more the largest page_id is kept; rows that repeat the largest id and
    payload are all kept as responses.  A null html is an empty payload; a null page_id is never the largest, and stays a
    response if its payload's ids are all null.  Payloads count as equal if their SHA-1 and length are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    size = F.octet_length("payload")
    large = rows.where(size >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("digest"), size.alias("size")).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    same = [rows["payload_digest"] == F.col("digest"), size == F.col("size")]
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.join(large.where("n > 1"), same, "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """Writes every page (page_id, url, html) to archives in the shared folder and reads them back; see ``read``.

    The folder is the result's own storage and stays as long as the shared folder does; callers who want the archives
    elsewhere, or gone, use ``write``, ``read`` and a path of theirs.  Extra columns of ``pages``, whatever their names,
    are not read; see ``deduplicated`` for nulls, ties and repeated rows.  An empty table gives an empty result."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write(deduplicated(pages), path)
    return read(spark, path)


def report(pages: DataFrame) -> DataFrame:
    """One row of facts for each archived record; see ``archive``."""
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages
), k AS (SELECT d, b, max(page_id) AS m FROM p WHERE b >= 1000 GROUP BY d, b)
SELECT page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m IS NOT NULL AND m IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.b = k.b
"""
