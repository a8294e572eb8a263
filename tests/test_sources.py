"""Readers, the index cache and the stream."""

import pytest

from peakloom.sources import readers
from peakloom.streaming.profiles import running_profile
from tests.conftest import DATA

FASTA = ">sp|P1|ONE first GN=ABC OS=x\nMKPAAAAAAK\nCCCCCCCR\n>plain second\r\nACDEFGHIK\r\n>sp|P3|EMPTY\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    got = {r.protein_id: r for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got["P1"].sequence == "MKPAAAAAAKCCCCCCCR" and got["P1"].gene_name == "ABC" and got["plain"].sequence == "ACDEFGHIK" and got["P3"].sequence == ""
    assert {r.protein_id for r in readers.read_fasta(spark, str(tmp_path / "a.fasta"), 10).collect()} == {"P1"}


def test_databases(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    (tmp_path / "p.tsv").write_text("sequence\tx\nPEPTIDEK\t1\nACDEFGHIK\t2\n")
    db = readers.from_fasta(spark, str(tmp_path / "a.fasta"), missed=0)
    assert db.where("NOT is_decoy").count() == 3
    with pytest.raises(NotImplementedError):
        readers.from_fasta(spark, "x", enzyme="lysc")
    assert readers.from_tsv(spark, str(tmp_path / "p.tsv"), with_decoys="reverse").count() == 4
    with pytest.raises(ValueError):
        readers.from_tsv(spark, str(tmp_path / "p.tsv"), "other")
    assert readers.from_list(spark, ["ILK"]).head().sequence_il == "LLK"


def test_cache(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    first = readers.cached_index(spark, [str(tmp_path / "a.fasta")], str(tmp_path / "cache"), missed=0)
    again = readers.cached_index(spark, [str(tmp_path / "a.fasta")], str(tmp_path / "cache"), missed=0)
    assert first.count() == again.count() and len(list((tmp_path / "cache").iterdir())) == 1
    readers.cached_index(spark, [str(tmp_path / "a.fasta")], str(tmp_path / "cache"), missed=1)
    assert len(list((tmp_path / "cache").iterdir())) == 2


def test_predictions(spark):
    wide = spark.createDataFrame([("PEP[Oxidation]TIDE", 2, 1, 0.5, 0.0, 1.0, 0.005)], "sequence string, charge int, position int, b_z1 double, b_z2 double, y_z1 double, y_z2 double")
    own = readers.unpivot_predictions(wide)
    assert {(r.sequence, r.ion_type, r.frag_charge) for r in own.collect()} == {("PEPTIDE", "b", 1), ("PEPTIDE", "y", 1)}
    assert readers.lookup_predictions(spark.createDataFrame([(1, "PEPTIDE", 2), (2, "PEPTIDE", 3)], "psm_id long, sequence string, charge int"), own).count() == 2


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = running_profile(stream).writeStream.format("memory").queryName("profile").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("profile").groupBy().sum("n").head()[0] == events.count()
