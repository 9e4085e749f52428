import gzip
import json

import pytest

from spanweave.sources import genomic as G
from spanweave.sources import sinks


def test_narrowpeak(spark, tmp_path):
    lines = ["# note", "", "chr1\t10\t50\tn\t5\t.\t2.5\t1\t1\t20", "track x", "chr2\t0\t9\tn\t1\t.\t1.0\t1\t1\t99"]
    p = tmp_path / "a.bed.gz"
    p.write_bytes(gzip.compress("\n".join(lines).encode()))
    got = G.read_narrowpeak(spark, str(p), "E1", "skip").collect()
    assert [(r.sample_id, r.chrom, r.start_bp, r.end_bp, r.signal, r.summit) for r in got] == [("E1:3", "chr1", 10, 50, 2.5, 30)]
    with pytest.raises(Exception, match="summit outside"):
        G.read_narrowpeak(spark, str(p), "E1").collect()
    assert {r.chrom for r in G.read_bed3(spark, str(p)).collect()} == {"chr1", "chr2"}


def test_hotspots(spark, tmp_path):
    p = tmp_path / "h.bed"
    p.write_text("chr1\t5\t20\tx\t7.5\t.\t9\t0\nchr1\t9\t9\tx\t1\t.\t9\t0\n")
    assert [(r.start_bp, r.signal, r.summit) for r in G.read_hotspots(spark, str(p), "A").collect()] == [(5, 7.5, 9)]


def test_fasta_windows(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">c1 first\nACGTAC\ngtacgt\n>c2\nTTTT\n")
    fa = G.read_fasta(spark, str(p))
    assert {r.name: r.seq for r in fa.collect()} == {"c1": "ACGTACGTACGT", "c2": "TTTT"}
    w = spark.createDataFrame([(1, "c1", 2, 9), (2, "c2", 0, 4)], "id long, chrom string, start_bp long, end_bp long")
    assert {r.id: r.seq for r in G.fetch_windows(w, G.chunked(fa, 4), 4).collect()} == {1: "GTACGTA", 2: "TTTT"}


def test_pfm(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"matrix_id": "M1", "pfm": {b: [i, i + 1] for i, b in enumerate("ACGT")}}, indent=1))
    assert {(r.base, r.pos): r.n for r in G.read_pfm(spark, str(p)).collect()}[("G", 1)] == 3.0


def test_sink_and_content_hash(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    sinks.write_csv(df, str(tmp_path / "o"), ["y", "x"])
    back = spark.read.csv(str(tmp_path / "o"), header=True, schema="y string, x int")
    assert back.columns == ["y", "x"]
    assert sinks.content_hash(back).first() == sinks.content_hash(df.repartition(3)).first()
