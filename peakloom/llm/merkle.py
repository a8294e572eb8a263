"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces, in built-in functions only.

Sections end at a blank line, paragraphs at a line break, and a paragraph's pieces, the tree's leaves, are runs of at most
``PIECE`` code points that end with a sentence.  A leaf is the SHA-256 of its text, and every node above is that of its
children's digests, up to the root; every split is reversible, so roots are equal just for equal texts.

A fingerprint string is the root, a colon and the tree: each leaf's first ``DIGITS`` hex digits, paragraphs parted by "-"
and sections by "/".  So a branch of one tree equals a branch of another just where their strings are equal, and two
fingerprints alone tell where texts differ: ``likeness`` and ``edits`` go down from the root and open only the branches
that the other tree lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, hash_share

PIECE, DIGITS = 64, 12
#: Text bytes that a block of rows in order should hold, and blocks at most.
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 20_000
#: Sampled keys for each block, from which the blocks' bounds are taken.
KEYS_PER_BLOCK = 12

_PIECES = rf"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def leaves(text: Column) -> Column:
    """The leaves' digests, by section and paragraph: array<array<array<string>>>."""
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECES), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def root(tree_of: Column) -> Column:
    return _node(F.transform(tree_of, lambda s: _node(F.transform(s, _node))))


def fingerprint(tree_of: Column) -> Column:
    """The fingerprint string of a text's ``leaves``."""
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, DIGITS)), "")
    return F.concat(root(tree_of), F.lit(":"), F.array_join(F.transform(tree_of, lambda s: F.array_join(F.transform(s, short), "-")), "/"))


def _sections(print_of: Column) -> Column:
    return F.split(F.substring(print_of, 66, 1 << 30), "/")


def _paragraphs(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(s, "-"))))


def _pieces(paragraphs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)))))


def _leaf_count(branches: Column) -> Column:
    return F.aggregate(branches, F.lit(0), lambda n, x: n + F.floor(F.length(F.translate(x, "-", "")) / DIGITS).cast("int"))


def compared(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Adds ``out``, the likeness of two fingerprint strings, 0 to 1: the share of leaves below equal branches.

    Sections that both have count with all their leaves; only others are opened, and of their paragraphs again only
    those that the other text's opened sections lack, down to the leaves.  A branch that a text repeats counts once.
    Equal fingerprints have 1, those of empty texts included.  Sets are hashed, so the work is linear in the texts."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    rows = rows.withColumns({"__a": F.array_distinct(_sections(l)), "__b": F.array_distinct(_sections(r))})
    rows = rows.withColumns({"__same": F.array_intersect("__a", "__b"), "__pa": _paragraphs(F.array_except("__a", "__b")), "__pb": _paragraphs(F.array_except("__b", "__a"))})
    rows = rows.withColumns({"__both": F.array_intersect("__pa", "__pb"), "__la": _pieces(F.array_except("__pa", "__pb")), "__lb": _pieces(F.array_except("__pb", "__pa"))})
    shared = _leaf_count(F.col("__same")) + _leaf_count(F.col("__both"))
    alike = 2.0 * (shared + F.size(F.array_intersect("__la", "__lb"))) / F.nullif(2 * shared + F.size("__la") + F.size("__lb"), F.lit(0))
    return rows.withColumn(out, F.when(l == r, 1.0).otherwise(F.coalesce(alike, F.lit(0.0)))).drop("__a", "__b", "__same", "__pa", "__pb", "__both", "__la", "__lb")


def tree(docs: DataFrame) -> DataFrame:
    """(doc_id, root, fingerprint) for every row; a null text counts as empty."""
    own = docs.select("doc_id", leaves(F.coalesce("text", F.lit(""))).alias("leaves"))
    return own.select("doc_id", root(F.col("leaves")).alias("root"), fingerprint(F.col("leaves")).alias("fingerprint"))


def edits(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two versions of documents differ: (doc_id, section, paragraph), counted from 0, of each paragraph of either
    version in a branch that the other lacks.  Both inputs are ``tree`` results; documents in one of them only are left
    out, and a document whose roots are equal is decided by the roots alone."""
    pair = left.alias("l").join(right.alias("r"), F.expr("l.doc_id = r.doc_id AND l.root <> r.root"))
    pair = pair.select(F.col("l.doc_id").alias("doc_id"), _sections(F.col("l.fingerprint")).alias("a"), _sections(F.col("r.fingerprint")).alias("b"))

    def found(own: str, other: str) -> DataFrame:
        """Paragraphs of sections that the other version doesn't have at their place, that aren't at theirs."""
        opened = pair.select("doc_id", F.posexplode(own).alias("section", "x"), F.col(other).alias("y")).withColumn("z", F.try_element_at("y", F.col("section") + 1))
        opened = opened.where(~F.col("x").eqNullSafe(F.col("z"))).select("doc_id", "section", F.split(F.coalesce("z", F.lit("")), "-").alias("theirs"), F.col("z").isNull().alias("alone"), F.posexplode(F.split("x", "-")).alias("paragraph", "p"))
        return opened.where(F.col("alone") | ~F.col("p").eqNullSafe(F.try_element_at("theirs", F.col("paragraph") + 1))).select("doc_id", "section", "paragraph")

    return found("a", "b").unionByName(found("b", "a")).distinct()


def _ordered_blocks(rows: DataFrame) -> DataFrame:
    """Adds ``block``: rows of a smaller block come before those of a larger one in the order of (k, tie, copy).

    Bounds are keys of a bounded sample, spread over rows by their bytes, however the ids lie; ties and repeated rows are
    parted like any others."""
    facts = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text") + 64)).head()
    blocks = min(MOST_BLOCKS, -(-(facts[1] or 0) // BLOCK_BYTES))
    if blocks < 2:
        return rows.withColumn("block", F.lit(0))
    keys = sorted(tuple(r) for r in hash_share(rows.select("k", "tie", "copy"), ["k", "tie", "copy"], blocks * KEYS_PER_BLOCK, facts[0]).collect())
    bounds = keys[:: max(1, -(-len(keys) // blocks))][1:]
    if not bounds:
        return rows.withColumn("block", F.lit(0))
    column = [F.lit([b[j] for b in bounds]) for j in range(3)]

    def reached(at: Column) -> Column:
        k, tie, copy = (F.element_at(c, at) for c in column)
        return (F.col("k") > k) | ((F.col("k") == k) & ((F.col("tie") > tie) | ((F.col("tie") == tie) & (F.col("copy") >= copy))))

    # a binary search: the number of bounds reached, found from its highest bit down
    steps = F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))])
    return rows.withColumn("block", F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & reached(F.least(n + s, F.lit(len(bounds)))), n + s).otherwise(n)))


def with_next(rows: DataFrame) -> DataFrame:
    """(k, text, ...) rows by (k, SHA-256 of the text) -> with ``next_text``, the next row's, or the first row's after the
    last.

    No window spans the table: rows are led inside blocks of bounded size.  Each block's last row is a guest: a copy of
    what the next block starts with, so nothing is joined and texts are exchanged once."""
    tie = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = _ordered_blocks(rows.withColumns({"tie": tie, "copy": F.monotonically_increasing_id(), "guest": F.lit(False)}))
    order = W.partitionBy("block").orderBy("guest", "k", "tie", "copy")
    opening = checkpoint(rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("block", "text"))
    number = W.orderBy("block")  # over the blocks' numbers: MOST_BLOCKS at most
    before = opening.select("block").withColumn("host", F.coalesce(F.lag("block").over(number), F.last("block").over(number.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    guests = opening.join(before, "block").select(F.col("host").alias("block"), "text", F.lit(True).alias("guest"))
    led = rows.unionByName(guests, allowMissingColumns=True).withColumn("next_text", F.lead("text").over(order))
    return led.where("NOT guest").drop("block", "tie", "copy", "guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness, besides that to the next document.

    The edited text replaces the last floor(n/2) code points by the first as many (or all) of the next document by
    ascending doc_id; the last document's next is the first.  Null texts count as empty; a null doc_id comes first; rows
    that repeat a doc_id are ordered by their texts' SHA-256; texts of any length are one value in one row.  Two empty
    texts have likeness 1.  Columns other than doc_id and text are not read.  An empty table gives an empty result.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("k", F.coalesce("doc_id", lowest)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_text")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(leaves(F.col(c)).alias(f"{c}_leaves") for c in ("text", "edited", "next_text")))
    prints = {"fingerprint": "text", "edited_fingerprint": "edited", "next_print": "next_text"}
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *(fingerprint(F.col(f"{c}_leaves")).alias(k) for k, c in prints.items()))
    rows = compared(compared(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_print", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _print_sql(c: str) -> str:
    piece = f"list_transform(regexp_extract_all(p, '{_PIECES}'), lambda x: sha256(x))"
    tree_of = f"list_transform(string_split({c}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {piece}))"
    return f"""(SELECT sha256(array_to_string(list_transform(t, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), '')) || ':' ||
      array_to_string(list_transform(t, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: x[:{DIGITS}]), '')), '-')), '/') FROM (SELECT {tree_of} AS t))"""


def _near_sql(a: str, b: str) -> str:
    less = lambda x, y: f"list_filter({x}, lambda e: NOT list_contains({y}, e))"
    count = lambda x: f"coalesce(list_sum(list_transform({x}, lambda e: length(replace(e, '-', '')) // {DIGITS})), 0)"
    flat = lambda x, y: f"list_distinct(flatten(list_transform({x}, lambda e: {y})))"
    return f"""(SELECT CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * (same + len(list_intersect(la, lb))) / nullif(2 * same + len(la) + len(lb), 0), 0.0::DOUBLE) END FROM (
      SELECT {count("same")} + {count("list_intersect(pa, pb)")} AS same, {flat(less("pa", "pb"), f"regexp_extract_all(e, '[0-9a-f]{{{DIGITS}}}')")} AS la, {flat(less("pb", "pa"), f"regexp_extract_all(e, '[0-9a-f]{{{DIGITS}}}')")} AS lb FROM (
        SELECT list_intersect(sa, sb) AS same, {flat(less("sa", "sb"), "string_split(e, '-')")} AS pa, {flat(less("sb", "sa"), "string_split(e, '-')")} AS pb FROM (
          SELECT list_distinct(string_split({a}[66:], '/')) AS sa, list_distinct(string_split({b}[66:], '/')) AS sb))))"""


SQL = f"""
WITH prints AS (SELECT doc_id, coalesce(text, '') AS t, {_print_sql("coalesce(text, '')")} AS f FROM documents
), ordered AS (
  SELECT doc_id, t, f, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt, coalesce(lead(f) OVER o, first_value(f) OVER o) AS nf
  FROM prints WINDOW o AS (ORDER BY doc_id NULLS FIRST, sha256(t))
), texts AS (SELECT doc_id, t, f, nf, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS e FROM ordered
), edited AS (SELECT doc_id, t, f, nf, e, {_print_sql("e")} AS ef FROM texts)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
  {_near_sql("f", "ef")} AS near_edited, {_near_sql("f", "nf")} AS near_next
FROM edited
"""
