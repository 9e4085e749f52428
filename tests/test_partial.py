"""Readers of several accessions, merged intervals, digests of files, letters that are not DNA, left joins with their check."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanweave.functions import sequence
from spanweave.operators import reports
from spanweave.sources import genomic, sinks


def test_merged_intervals(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\nchr1\t5\t9\nchr1\t9\t12\nchr2\t0\t3\nchr1\t20\t30\nchr1\t22\t25\n")
    assert sorted(map(tuple, genomic.read_merged_bed3(spark, str(tmp_path / "a.bed")).collect())) == [("chr1", 5, 12), ("chr1", 20, 30), ("chr2", 0, 3)]


def test_accessions_are_put_together_in_order(spark, tmp_path):
    peak = "chr1\t{0}\t{1}\tn\t9\t.\t{2}\t-1\t-1\t{3}\n"
    (tmp_path / "x.bed").write_text(peak.format(50, 60, 1.5, 3) + peak.format(10, 20, 2.5, 99) + peak.format(10, 20, 2.5, 1))
    (tmp_path / "y.bed").write_text("track\n" + peak.format(10, 20, 3.5, 0))
    got = genomic.read_accessibility(spark, {"y": str(tmp_path / "y.bed"), "x": str(tmp_path / "x.bed")}, "narrowPeak").collect()
    assert [(r["accession"], r["row_number"], r["start_bp"], r["signal"], r["summit"]) for r in got] == [("y", 2, 10, 3.5, 10), ("x", 3, 10, 2.5, 11), ("x", 1, 50, 1.5, 53)]
    (tmp_path / "h.bed").write_text("chr1\t5\t9\tn\t7.5\t.\t6\tz\nchr1\t5\t9\tn\t7.5\t.\t9\tz\n")
    hot = genomic.read_accessibility(spark, {"h": str(tmp_path / "h.bed")}, "hotspot").collect()
    assert [(r["signal"], r["summit"]) for r in hot] == [(7.5, 6)]
    with pytest.raises(ValueError, match="kind"):
        genomic.read_accessibility(spark, {}, "other")


def test_digests_of_files(spark, tmp_path):
    held = {"a.bin": b"", "b.gz": bytes(range(256)) * 20_000, "c d.txt": b"x"}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): r for r in sinks.file_digests(spark, str(tmp_path)).collect()}
    del held["a.bin"]  # empty files have no row
    assert {n: (r["bytes"], r["md5"], r["sha256"]) for n, r in got.items()} == {n: (len(x), hashlib.md5(x).hexdigest(), hashlib.sha256(x).hexdigest()) for n, x in held.items()}


@pytest.mark.parametrize(("text", "said"), [("ACxGTNx", "letters NX"), ("", "empty"), (None, "null")])
def test_letters_that_are_not_dna_are_listed(spark, text, said):
    d = spark.createDataFrame([(text,)], "s string")
    with pytest.raises(Exception, match=f"not a DNA sequence: {said}"):
        d.select(sequence.checked_dna(F.col("s"))).collect()


def test_one_to_one_left_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c")], "k int, y string")
    assert sorted(map(tuple, reports.join_one_to_one(a, b, ["k"], "left").collect())) == [(1, "a", "c"), (2, "b", None)]
    with pytest.raises(Exception):  # noqa: B017
        reports.join_one_to_one(a, b.union(b), ["k"], "left").collect()


def test_csv_by_value(spark, tmp_path):
    d = spark.createDataFrame([(1, "p", 0.5), (2, "n", 1.5)], "id int, label string, v double")
    sinks.write_csv(d, str(tmp_path / "out"), ["id", "v", "label"], by="label")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["label=n", "label=p"]
    back = spark.read.csv(str(tmp_path / "out"), header=True, schema="id int, v double, label string")
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, "p"), (2, 1.5, "n")]
