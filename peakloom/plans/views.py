"""Domain relations derived from the driver's tables; each select list runs in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_peaks": ("orders", [
        "o_orderkey AS peak_id", "CAST(o_custkey % 50 AS INT) AS scan", "200.0 + (o_totalprice % 1800.0) AS mz",
        "100.0 + (o_totalprice * 13.0) % 9000.0 AS intensity", "CAST(o_custkey % 600 AS DOUBLE) AS rt_sec",
    ]),
    "v_hits": ("lineitem", ["CAST(l_suppkey % 100 AS INT) AS scan", "200.0 + (l_extendedprice % 1800.0) AS mz", "l_quantity * 100.0 AS intensity"]),
    "v_targets": ("part", ["p_partkey % 400 AS pep_id", "CAST(floor(p_partkey / 400) AS BIGINT) AS frag_id", "200.0 + ((p_retailprice * 1.37) % 1800.0) AS target_mz"]),
    "v_features": ("orders", [
        "o_orderkey AS feature_id", "200.0 + (o_totalprice % 1800.0) AS mz", "CAST(o_custkey % 60 AS DOUBLE) AS rt", "1000.0 + (o_totalprice * 13.0) % 90000.0 AS intensity",
        "0.5 + (o_totalprice * 7.0) % 30.0 AS fwhm_sec", "CAST(o_orderkey % 5 AS INT) AS charge", "(o_totalprice * 3.0) % 12.0 AS mz_std_ppm",
        "CAST(o_custkey % 14 AS INT) AS n_peaks", "CAST(o_custkey % 8 AS INT) AS n_scans",
    ]),
    "v_psms": ("events", ["event_id AS psm_id", "value AS score", "event_type = 'error' AS is_decoy", "user_id AS group_id"]),
    "v_matches": ("events", [
        "user_id AS psm_id", "event_id AS fragment", "CAST(event_id % 2 AS INT) AS ion_type", "CAST(1 + event_id % 17 AS INT) AS position", "CAST(1 + event_id % 3 AS INT) AS charge",
        "value AS intensity", "(value * 7.0) % 40.0 - 20.0 AS ppm", "(value * 3.0) % 10.0 AS rt_diff",
    ]),
    "v_pairs": ("events", ["event_type AS run_id", "CAST(value AS DOUBLE) AS irt", "value * 6.0 + CAST(event_id % 7 AS DOUBLE) AS rt_sec"]),
    "v_calibration": ("orders", ["200.0 + (o_totalprice % 1800.0) AS theoretical_mz", "(200.0 + (o_totalprice % 1800.0)) * (1.0 + ((o_totalprice * 11.0) % 12.0 - 4.0) / 1000000.0) AS observed_mz", "CAST(o_custkey % 1400 AS DOUBLE) AS rt_sec"]),
    "v_dda": ("events", [
        "event_id AS psm_id", "value AS hyperscore", "(value * 3.0) % 5.0 AS delta_score", "CAST(event_id % 23 AS INT) AS matched_peaks", "CAST(event_id % 9 AS INT) AS matched_b",
        "CAST(event_id % 12 AS INT) AS matched_y", "concat('PEKT', event_type, 'R') AS sequence", "CAST(2 + event_id % 3 AS INT) AS charge", "event_type = 'error' AS is_decoy", "(value * 11.0) % 1.0 AS dl_similarity",
    ]),
}

_CLEAN = {False: "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '')), '[^ACDEFGHIKLMNPQRSTVWY]', '')", True: "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"}
#: Common table expressions of all views for DuckDB; unused ones cost nothing.
CTE = ", ".join(f"{name} AS (SELECT {', '.join(columns)} FROM {table})" for name, (table, columns) in VIEWS.items()) + f"""
, v_proteins AS (SELECT doc_id AS protein_id, {_CLEAN[True]} AS sequence FROM documents)
, v_items AS (SELECT item_id AS protein_id, {_CLEAN[True]} AS sequence FROM benchmark)
, v_profiles AS (SELECT vec_id, pos - 1 AS pos, CAST(pos - 1 AS DOUBLE) * 0.5 AS x, abs(CAST(embedding[pos] AS DOUBLE)) AS value, label FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS pos))"""

Query = Callable[[SparkSession, str], DataFrame]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name in ("v_proteins", "v_items"):
        table, key = ("documents", "doc_id") if name == "v_proteins" else ("benchmark", "item_id")
        return read(table).selectExpr(f"{key} AS protein_id", f"{_CLEAN[False]} AS sequence")
    if name == "v_profiles":
        own = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
        return own.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.col("pos").cast("double") * 0.5).alias("x"), F.abs(F.col("e").cast("double")).alias("value"), "label")
    if name not in VIEWS:
        return read(name)
    table, columns = VIEWS[name]
    return read(table).selectExpr(*columns)


class Registry:
    """Queries with their SQL; named columns are rounded on both sides, as sums differ in their last bits."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None, doubles: str = "", digits: int = 6):
        names = doubles.split()

        def wrap(make):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = make(lambda v: view(spark, sf_dir, v), spark)
                return out.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names}) if names else out

            query.__name__ = name
            self.queries[name] = query
            if sql is not None:
                out = f" REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}' for c in names)})" if names else ""
                head, _, body = sql.partition("::")
                extra = f", {head.strip()}" if head.strip() else ""
                self.oracles[name] = f"WITH {CTE}{extra} SELECT *{out} FROM ({body})"
            return make

        return wrap
