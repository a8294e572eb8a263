"""Every query that SQL can state, against DuckDB."""

import math

import pytest
from pyspark.sql import functions as F

from peakloom.plans import registry
from peakloom.plans.views import view
from tests.conftest import DATA, TABLES, canon


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns


def test_no_nested_loops(spark):
    """Band joins plan as equi-joins."""
    for name in ("band_nearest", "band_all", "xic_long", "isotope_simple", "mass_search_ppm"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rescoring_fits_the_whole_forest(spark, monkeypatch):
    from peakloom.operators import rescoring

    made, real = [], rescoring.RandomForestClassifier
    monkeypatch.setattr(rescoring, "RandomForestClassifier", lambda **k: made.append((k["numTrees"], k["maxDepth"])) or real(**k))
    assert registry.QUERIES["rf_rescore"](spark, DATA).count() == 1000
    assert made == [(200, 10)] * 3


def _coeluting_by_loops(references, peaks, ppm, scan_window, least):
    """(ref_id, peak_id) pairs by plain loops: one reference, one peak, one centre at a time."""
    found = set()
    for ref_id, ref_mz, ref_scan in references:
        in_time = [p for p in peaks if abs(p[1] - ref_scan) <= scan_window]
        near = sorted(p for p in in_time if abs(p[2] - ref_mz) <= ref_mz * 3 * ppm / 1e6)
        centers, taken = [], set()
        for peak_id, _, mz, _ in near:
            if peak_id not in taken:
                own = [p for p in near if p[0] not in taken and abs(p[2] - mz) <= mz * 11 / 1e6]
                taken |= {p[0] for p in own}
                centers.append(sum(p[2] for p in own) / len(own))
        chromatograms = [{} for _ in centers]
        for _, scan, mz, intensity in near:
            off, k = min((abs(mz - c), k) for k, c in enumerate(centers))
            if off <= centers[k] * 11 / 1e6:
                chromatograms[k][scan] = chromatograms[k].get(scan, 0.0) + intensity
        if not centers or not chromatograms[0]:
            continue
        for k, (center, own) in enumerate(zip(centers, chromatograms)):
            norm = math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in chromatograms[0].values()))
            dot = sum(x * chromatograms[0].get(scan, 0.0) for scan, x in own.items())
            if own and (k == 0 or dot >= least * norm):
                found |= {(ref_id, p[0]) for p in in_time if abs(p[2] - center) <= center * 11 / 1e6}
    return found


def test_coeluting_group_equals_loops(spark):
    targets, peaks = view(spark, DATA, "v_targets").collect(), [(r.peak_id, r.scan, r.mz, r.intensity) for r in view(spark, DATA, "v_peaks").collect()]
    scan_of = {p[0]: p[1] for p in peaks}
    references = [(t.frag_id * 400 + t.pep_id, t.target_mz, scan_of[t.pep_id]) for t in targets if t.pep_id in scan_of]
    got = registry.QUERIES["coeluting_group"](spark, DATA)
    want = _coeluting_by_loops(references, peaks, 100.0, 5, 0.8)
    assert len(want) > 20
    assert sorted((r.ref_id, r.peak_id) for r in got.collect()) == sorted(want)


def test_retention_queries_on_copies_equal_their_sql(spark, tmp_path):
    """Copies tie in all that the SQL sorts by.  DuckDB has one thread: on several the SQL's two windows may sort ties apart."""
    import duckdb

    copies = view(spark, DATA, "events").crossJoin(spark.range(6).toDF("copy")).withColumn("event_id", F.col("event_id") + F.col("copy") * 700_000).drop("copy")
    copies.orderBy(F.rand(1)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f'{tmp_path}/events.parquet/*.parquet' if t == 'events' else f'{DATA}/{t}.parquet'}'")
    for name in ("rt_dedup", "rt_ols", "rt_knots", "pchip_segments", "pchip_predict", "rt_pchip_fit"):
        assert canon(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(con.sql(registry.ORACLES[name]).df()), name
