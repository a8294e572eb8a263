"""License scans by canonical digest.

A text is made canonical line by line (case, copyright lines, punctuation, equivalent spellings), its lines are joined and
hashed, and the digest is looked up among those of known licences, which went through the same expression.  Whole texts are joined with them, and each line is looked up as well, as
notices mostly stand alone in a longer text.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint

#: Known digests are looked up in place up to so many; more are joined by a shuffle.
INLINE_ROWS = 2000

_COPYRIGHT = r"^[^a-z0-9]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[|by )|\(c\)|©|all rights reserved)"
_BREAK = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’–—•©]+"
# Spellings that licence texts use for the same word.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("cancelled", "canceled"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
)
# One-line notices.
NOTICES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}
#: Titles that may stand above a licence whose own text has none.
TITLES = {
    "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License", "MIT": "MIT License", "Zlib": "zlib License",
}


def known_texts(folder: Path = Path(__file__).parent / "known") -> list[tuple[str, str]]:
    """(license_id, text): the files of a folder, named by licence, each with its title as well where it has one; notices."""
    whole = [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]
    return [*whole, *((name, f"{TITLES[name]}\n{text}") for name, text in whole if name in TITLES), *NOTICES.items()]


def canonical_lines(text: Column) -> Column:
    """The lines that are left, each with its words apart by one space; spellings don't reach over lines.

    The whole text goes through each step once, line breaks held apart from words, and is split at the end."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~line.rlike(_COPYRIGHT))
    out = F.concat(F.lit(" "), F.array_join(lines, " \n "), F.lit(" "))
    out = F.regexp_replace(out, _BREAK, " ")
    for spelling, word in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {word} "))
    return F.filter(F.transform(F.split(out, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical(lines: Column) -> Column:
    return F.array_join(lines, " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id); of licences with equal canonical texts the first by name counts.  Default: ``known_texts()``."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices) for every row of ``docs`` (doc_id, text; others are not read).

    license_id: the licence that the whole text is, else null; notices: the licences that single lines are, sorted and
    joined by commas (none: empty).  Null texts count as empty; a text of any length is made canonical once, as one value.
    Repeated rows each get the same result.  An empty table gives an empty result; with no known licence nothing is found.

    Up to ``INLINE_ROWS`` known digests are looked up among a text's line digests where the text is, so nothing is
    exchanged; more are joined by shuffle, line by line."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(text).alias("kept"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("kept")), 256).alias("digest"), F.transform(F.array_distinct("kept"), lambda line: F.sha2(line, 256)).alias("lines"))
    few = known.select("digest", "license_id").limit(INLINE_ROWS + 1).collect()
    if len(few) <= INLINE_ROWS:
        names = F.create_map(*[F.lit(x) for r in few for x in (r["digest"], r["license_id"])]) if few else F.create_map(F.lit(""), F.lit(""))
        found = F.transform(F.array_intersect("lines", F.lit([r["digest"] for r in few] or [""])), lambda d: F.element_at(names, d))
        rows = rows.withColumn("notices", F.array_join(F.array_sort(F.array_distinct(found)), ","))
        known = F.broadcast(known)
    else:
        rows = checkpoint(rows.withColumn("row", F.xxhash64("digest", F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull())))
        lines = rows.select("row", "digest", F.explode("lines").alias("line")).distinct().join(known.withColumnRenamed("digest", "line"), "line")
        notices = lines.groupBy("row", "digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
        rows = rows.join(notices, ["row", "digest"], "left")
    whole = rows.join(known, "digest", "left")
    return whole.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _lines_sql(text: str) -> str:
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda line: NOT regexp_matches(line, '{_COPYRIGHT}'))"
    out = f"regexp_replace(' ' || array_to_string({lines}, ' ' || chr(10) || ' ') || ' ', '{_BREAK}', ' ', 'g')"
    for spelling, word in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {word} ')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda line: trim(line)), lambda line: line <> '')"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH given(license_id, t) AS (VALUES {", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in known_texts())}
), known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256(array_to_string({_lines_sql("t")}, ' ')) AS digest FROM given) GROUP BY digest
), d AS (SELECT row_number() OVER () AS r, doc_id, {_lines_sql("coalesce(text, '')")} AS kept FROM documents
), lines AS (SELECT r, unnest(list_distinct(kept)) AS l FROM d
), notices AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM (SELECT r, sha256(l) AS digest FROM lines) JOIN known USING (digest) GROUP BY r
)
SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, sha256(array_to_string(kept, ' ')) AS canonical_sha256 FROM d) LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN notices USING (r)
"""
