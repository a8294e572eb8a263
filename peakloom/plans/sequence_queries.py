"""Queries over sequences: digestion, masses, decoys, fragments and mass search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import H2O, ISOTOPE_SPACING, MASSES, MODIFICATIONS, PROTON
from ..functions import decoys, isotopes, mass, sql
from ..operators import sequences
from ..operators.joins import window_totals
from .views import Registry

R = Registry()

_MASS = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) * CAST({m} AS DOUBLE)" for c, m in MASSES.items()) + f" + CAST({H2O} AS DOUBLE)"


def mass_sql(s: str) -> str:
    return "(" + _MASS.format(s) + ")"


def digest_sql(source: str, missed: int) -> str:
    cut = "list_filter(string_split(replace(replace(replace(replace(sequence, 'K', 'K|'), 'R', 'R|'), 'K|P', 'KP'), 'R|P', 'RP'), '|'), lambda x: x <> '')"
    return f"""cuts AS (SELECT protein_id, {cut} AS pieces FROM {source}),
    digested AS (SELECT protein_id, m AS missed, array_to_string(pieces[i:i + m], '') AS peptide FROM cuts, (SELECT unnest(generate_series(0, {missed})) AS m), LATERAL (SELECT unnest(generate_series(1, len(pieces) - m)) AS i)),
    peps AS (SELECT * FROM digested WHERE length(peptide) BETWEEN 7 AND 35)"""


@R.add("digest_peptides", digest_sql("v_proteins", 2) + ":: SELECT CAST(missed AS INTEGER) AS missed, peptide, count(*) AS n, count(DISTINCT protein_id) AS n_proteins FROM peps GROUP BY ALL")
def _(v, spark):
    own = sequences.digest(v("v_proteins"), 2).groupBy("missed", "peptide", "protein_id").agg(F.count(F.lit(1)).alias("k"))
    return own.groupBy("missed", "peptide").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_proteins"))


@R.add("peptide_masses", digest_sql("v_proteins", 0) + f", d AS (SELECT DISTINCT peptide AS sequence FROM peps), e AS (SELECT sequence, replace(sequence, 'I', 'L') AS sequence_il, CAST(length(sequence) AS INTEGER) AS length, {mass_sql('sequence')} AS neutral_mass FROM d):: SELECT *, (neutral_mass + 2 * CAST({PROTON} AS DOUBLE)) / 2 AS mz2, (neutral_mass + 3 * CAST({PROTON} AS DOUBLE)) / 3 AS mz3 FROM e", "neutral_mass mz2 mz3")
def _(v, spark):
    own = sequences.digest(v("v_proteins"), 0).select(F.col("peptide").alias("sequence")).distinct()
    own = sequences.mass_index(own)
    return own.withColumns({"mz2": mass.precursor_mz(F.col("neutral_mass"), 2), "mz3": mass.precursor_mz(F.col("neutral_mass"), 3)})


@R.add("decoys_all", digest_sql("v_proteins", 0) + ", d AS (SELECT DISTINCT peptide AS s FROM peps):: SELECT s AS sequence, s[1:1] || reverse(s[2:length(s) - 1]) || s[length(s):length(s)] AS diann, reverse(s[1:length(s) - 1]) || s[length(s):length(s)] AS pseudo_reverse, reverse(s) AS reversed, translate(reverse(s), 'KR', 'RK') AS kr_swap FROM d")
def _(v, spark):
    s = F.col("peptide")
    own = sequences.digest(v("v_proteins"), 0).select("peptide").distinct()
    return own.select(s.alias("sequence"), decoys.diann(s).alias("diann"), decoys.pseudo_reverse(s).alias("pseudo_reverse"), decoys.reverse(s).alias("reversed"), decoys.kr_swap(s).alias("kr_swap"))


_UNION = digest_sql("v_proteins", 0) + """, t AS (SELECT DISTINCT peptide AS s FROM peps), m AS (SELECT DISTINCT s[1:1] || reverse(s[2:length(s) - 1]) || s[length(s):length(s)] AS s FROM t),
    db AS (SELECT s AS sequence, false AS is_decoy FROM t UNION ALL SELECT s, true FROM m WHERE s NOT IN (SELECT s FROM t))"""


@R.add("target_decoy_union", _UNION + f":: SELECT sequence, is_decoy, CASE WHEN is_decoy THEN 'DECOY_' || sequence ELSE sequence END AS accession, {mass_sql('sequence')} AS neutral_mass FROM db", "neutral_mass")
def _(v, spark):
    own = sequences.target_decoy_database(v("v_proteins"), 0)
    return own.select("sequence", "is_decoy", "accession", "neutral_mass")


@R.add("digest_proteins", digest_sql("v_proteins", 2) + ", g AS (SELECT doc_id AS protein_id, 'tryptic GN=' || coalesce(source, 'none') || ' ' || coalesce(lang, '') AS description FROM documents), c AS (SELECT protein_id, count(DISTINCT peptide) AS n FROM peps GROUP BY protein_id):: SELECT protein_id, regexp_extract(description, 'GN=([^ ]*)', 1) AS gene, CAST(length(sequence) AS INTEGER) AS length, coalesce(n, 0) AS n_peptides FROM v_proteins JOIN g USING (protein_id) LEFT JOIN c USING (protein_id)")
def _(v, spark):
    named = v("documents").select(F.col("doc_id").alias("protein_id"), F.concat(F.lit("tryptic GN="), F.coalesce("source", F.lit("none")), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("description"))
    facts = sequences.digest_proteins(v("v_proteins"))[1].select("protein_id", "length", "n_peptides")  # texts aren't exchanged
    return facts.join(named, "protein_id").select("protein_id", sequences.gene_name(F.col("description")).alias("gene"), "length", "n_peptides")


@R.add("sql_functions", f":: SELECT peak_id, (mz - 1000.0) / 1000.0 * 1e6 AS ppm, (mz * 2 - 2 * CAST({PROTON} AS DOUBLE)) AS mass, (mz + 3 * CAST({PROTON} AS DOUBLE)) / 3 AS mz3, CAST(floor(ln(mz) / ln(1 + 20.0 / 1e6)) AS BIGINT) AS bin, mz / (1 + 3.5 / 1e6) AS corrected FROM v_peaks", "ppm mass mz3 corrected", 5)
def _(v, spark):
    sql.register(spark)
    return v("v_peaks").selectExpr("peak_id", "ppm_error(mz, 1000.0D) AS ppm", "mass_from_mz(mz, 2) AS mass", "precursor_mz(mz, 3) AS mz3", "mz_log_bin(mz, 20.0D) AS bin", "correct_mz(mz, 3.5D) AS corrected")


@R.add("sql_peptides", digest_sql("v_items", 1) + f":: SELECT protein_id AS item_id, missed, peptide, {mass_sql('peptide')} AS mass, peptide[1:1] || reverse(peptide[2:length(peptide) - 1]) || peptide[length(peptide):length(peptide)] AS decoy FROM peps", "mass")
def _(v, spark):
    sql.register(spark)
    v("v_items").createOrReplaceTempView("own_items")
    return spark.sql("SELECT protein_id AS item_id, p.missed, p.peptide, peptide_mass(p.peptide) AS mass, diann_decoy(p.peptide) AS decoy FROM own_items, LATERAL tryptic_peptides(sequence, 1) AS p WHERE length(p.peptide) BETWEEN 7 AND 35")


@R.add("shuffle_decoys", None)
def _(v, spark):
    s = F.col("peptide")
    own = sequences.digest(v("v_proteins"), 0).select("peptide").distinct()
    return own.select(s.alias("sequence"), decoys.shuffled(s).alias("decoy"), decoys.same_mass(s, decoys.shuffled(s)).alias("same_mass"))


_PRECURSORS = f"q AS (SELECT peak_id, CAST(2 + peak_id % 2 AS INTEGER) AS charge, mz * (2 + peak_id % 2) - (2 + peak_id % 2) * CAST({PROTON} AS DOUBLE) AS mass FROM v_peaks)"


def _masses(v):
    """A mass for each sequence, with 1 as a target or as a decoy."""
    db = sequences.target_decoy_database(v("v_proteins"), 0)
    return db.select(F.col("neutral_mass").alias("m"), (~F.col("is_decoy")).cast("long").alias("targets"), F.col("is_decoy").cast("long").alias("decoys"))


def _precursors(v):
    charge = (2 + F.col("peak_id") % 2).cast("int")
    return v("v_peaks").select("peak_id", charge.alias("charge"), mass.mass_from_mz(F.col("mz"), charge).alias("mass"))


@R.add("mass_search_ppm", _UNION + f", n AS (SELECT is_decoy, {mass_sql('sequence')} AS m FROM db), {_PRECURSORS}:: SELECT peak_id, charge, count(*) AS n_candidates, count(*) FILTER (WHERE is_decoy) AS n_decoys FROM q JOIN n ON m BETWEEN mass - mass * 5.0 / 1e6 AND mass + mass * 5.0 / 1e6 GROUP BY ALL")
def _(v, spark):
    per = window_totals(_precursors(v), _masses(v), 5.0, ["targets", "decoys"], "mass", "m")
    return per.select("peak_id", "charge", (F.col("targets") + F.col("decoys")).alias("n_candidates"), F.col("decoys").alias("n_decoys"))


@R.add("peptide_candidates", _UNION + f", n AS (SELECT is_decoy, {mass_sql('sequence')} AS m FROM db), {_PRECURSORS}:: SELECT charge, is_decoy, count(*) AS n_candidates, count(DISTINCT peak_id) AS n_precursors FROM q JOIN n ON m BETWEEN mass - mass * 5.0 / 1e6 AND mass + mass * 5.0 / 1e6 GROUP BY ALL")
def _(v, spark):
    per = window_totals(_precursors(v), _masses(v), 5.0, ["targets", "decoys"], "mass", "m")
    per = per.select("charge", F.explode(F.array(F.struct(F.lit(False).alias("is_decoy"), F.col("targets").alias("k")), F.struct(F.lit(True).alias("is_decoy"), F.col("decoys").alias("k")))).alias("x")).select("charge", "x.*").where("k > 0")
    return per.groupBy("charge", "is_decoy").agg(F.sum("k").alias("n_candidates"), F.count(F.lit(1)).alias("n_precursors"))


ITEM_PEPTIDES = digest_sql("v_items", 1) + ", d AS (SELECT DISTINCT peptide AS sequence FROM peps)"
FRAGMENTS = f"""{ITEM_PEPTIDES}, res AS (SELECT sequence, p, map_extract(MAP {{{", ".join(f"'{c}': CAST({m} AS DOUBLE)" for c, m in MASSES.items())}}}, sequence[p:p])[1] AS m FROM d, LATERAL (SELECT unnest(generate_series(1, length(sequence))) AS p)),
    pre AS (SELECT sequence, p, sum(m) OVER (PARTITION BY sequence ORDER BY p) AS b, sum(m) OVER (PARTITION BY sequence) AS w, length(sequence) AS n FROM res),
    frags AS (SELECT sequence, CAST(t AS SMALLINT) AS ion_type, CAST(CASE WHEN t = 0 THEN p ELSE n - p END AS SMALLINT) AS position, CAST(z AS SMALLINT) AS charge,
      ((CASE WHEN t = 0 THEN b ELSE w - b + CAST({H2O} AS DOUBLE) END) + z * CAST({PROTON} AS DOUBLE)) / z AS mzd
      FROM pre, (SELECT unnest([0, 1]) AS t), (SELECT unnest([1, 2]) AS z) WHERE p < n AND z <= CASE WHEN t = 0 THEN p ELSE n - p END)"""


def item_fragments(v):
    own = sequences.digest(v("v_items"), 1).select(F.col("peptide").alias("sequence")).distinct()
    return sequences.fragments(own)


@R.add("by_fragments", FRAGMENTS + ":: SELECT sequence, ion_type, position, charge, CAST(mzd AS FLOAT) AS mz FROM frags", "mz", 3)
def _(v, spark):
    return item_fragments(v)


_DELTA = MODIFICATIONS["Oxidation"]


@R.add("modified_by_fragments", FRAGMENTS + f", x AS (SELECT *, length(sequence) AS n FROM frags):: SELECT sequence, ion_type, position, charge, CAST(mzd + CASE WHEN (ion_type = 0 AND position > 2) OR (ion_type = 1 AND position >= n - 2) THEN CAST({_DELTA} AS DOUBLE) / charge ELSE 0 END AS FLOAT) AS mz FROM x", "mz", 2)
def _(v, spark):
    own = sequences.digest(v("v_items"), 1).select(F.col("peptide").alias("sequence")).distinct()
    mods = mass.shifts(mass.parse_modifications(F.lit("Oxidation@M"), F.lit("3")))
    return sequences.fragments(own, modifications=mods)


@R.add("modified_mass", digest_sql("v_proteins", 0) + f", d AS (SELECT DISTINCT peptide AS sequence FROM peps):: SELECT sequence, {mass_sql('sequence')} + {MODIFICATIONS['Carbamidomethyl']} + {MODIFICATIONS['Acetyl']} AS modified_mass, 2 AS n_mods FROM d", "modified_mass")
def _(v, spark):
    own = sequences.digest(v("v_proteins"), 0).select(F.col("peptide").alias("sequence")).distinct()
    mods = mass.parse_modifications(F.lit("Carbamidomethyl@C;Acetyl@K;broken"), F.lit("1;2;x"))
    return own.select("sequence", mass.modified_mass(F.col("sequence"), mods).alias("modified_mass"), F.size(mods).alias("n_mods"))


@R.add("parse_mods", ":: SELECT event_id, 'Oxidation' AS name, CAST(event_id % 30 AS INTEGER) AS position, CAST(15.994915 AS DOUBLE) AS delta FROM events UNION ALL SELECT event_id, event_type, 4, CAST(0 AS DOUBLE) FROM events", "delta")
def _(v, spark):
    own = v("v_psms").selectExpr("psm_id AS event_id").join(v("v_matches").selectExpr("fragment AS event_id"), "event_id")
    typed = v("v_dda").selectExpr("psm_id AS event_id", "substring(sequence, 5, length(sequence) - 5) AS t").join(own, "event_id")
    mods = mass.parse_modifications(F.concat(F.lit("Oxidation@M;"), "t", F.lit("@K;nothing")), F.concat((F.col("event_id") % 30 + 1).cast("string"), F.lit(";5;7")))
    out = typed.select("event_id", F.explode(F.arrays_zip(mods.alias("m"), mass.shifts(mods).alias("s"))).alias("x"))
    return out.select("event_id", F.col("x.m.name").alias("name"), F.col("x.m.position").alias("position"), F.col("x.s.delta").alias("delta"))


@R.add("isotope_pattern", digest_sql("v_proteins", 0) + f", d AS (SELECT DISTINCT peptide AS sequence FROM peps), e AS (SELECT sequence, {mass_sql('sequence')} * 0.5 / 12 * 0.011 AS l FROM d):: SELECT sequence, l * exp(-l) AS m1, l * l / 2 * exp(-l) AS m2, pow(l, 4) / 24 * exp(-l) AS m4, l AS m1_poisson, {ISOTOPE_SPACING} * 3 / 2 + 500.0 AS rung3 FROM e", "m1 m2 m4 m1_poisson rung3")
def _(v, spark):
    own = sequences.digest(v("v_proteins"), 0).select(F.col("peptide").alias("sequence")).distinct()
    m = mass.neutral_mass(F.col("sequence"))
    ladder = sequences.isotope_ladder(F.lit(500.0), F.lit(2))
    return own.select("sequence", isotopes.pattern(m)[1].alias("m1"), isotopes.pattern(m)[2].alias("m2"), isotopes.pattern(m)[4].alias("m4"), isotopes.pattern(m, mode="poisson")[1].alias("m1_poisson"), ladder[3].alias("rung3"))


@R.add("scalar_functions", f":: SELECT peak_id, CAST(floor(ln(mz) / ln(1 + 20.0 / 1e6)) AS BIGINT) AS bin, (mz - 1000.0) / 1000.0 * 1e6 AS ppm, (1000.0 - (mz - CAST({PROTON} AS DOUBLE)) + CAST({PROTON} AS DOUBLE)) AS complement, mz / (1 + 3.5 / 1e6) AS corrected, ln(factorial(CAST(peak_id % 12 AS INTEGER))) AS lnfact FROM v_peaks", "ppm complement corrected lnfact", 5)
def _(v, spark):
    mz = F.col("mz")
    return v("v_peaks").select("peak_id", mass.log_bin(mz, 20.0).alias("bin"), mass.ppm_error(mz, F.lit(1000.0)).alias("ppm"), mass.complementary_mz(F.lit(1000.0), mz, F.lit(1), 1).alias("complement"), mass.correct_mz(mz, F.lit(3.5)).alias("corrected"), mass.log_factorial((F.col("peak_id") % 12).cast("int")).alias("lnfact"))
