"""FASTA as a stream and by index, windows fetched from it, and audits of two references."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.operators import audit
from spanweave.sources import fasta, genomic


def records(rng):
    out = {f"chr{i}": "".join(rng.choices("ACGTNacgt", k=n)) for i, n in enumerate((0, 1, 99, 100, 101, 250, 1000))}
    return out | {"long": "".join(rng.choices("ACGT", k=5000))}


def written(path, held, width, end="\n"):
    lines = []
    for name, seq in held.items():
        lines.append(f">{name} some words > more")
        lines += [seq[i : i + width] for i in range(0, len(seq), width)]
    path.write_bytes((end.join(lines) + end).encode())
    return str(path)


def chunks_of(held, size):
    return sorted((n, i // size, s[i : i + size].upper()) for n, s in held.items() for i in range(0, len(s), size))


@pytest.mark.parametrize(("width", "size", "end"), [(60, 100, "\n"), (7, 33, "\r\n"), (10_000, 64, "\n")])
def test_chunks_of_plain_and_gzip_files(spark, tmp_path, width, size, end):
    held = records(random.Random(1))
    path = written(tmp_path / "a.fa", held, width, end)
    packed = tmp_path / "b.fa.gz"
    packed.write_bytes(gzip.compress((tmp_path / "a.fa").read_bytes()))
    for p in (path, "file://" + path, str(packed)):
        assert sorted(map(tuple, fasta.read_fasta_chunks(spark, p, size).collect())) == chunks_of(held, size)


def test_chunks_by_index(spark, tmp_path):
    """With an index a record is read by many tasks, each from its own byte on; an index that does not fit is an error."""
    held = {"x": "".join(random.Random(2).choices("ACGT", k=20_000)), "y": "ACGTA"}
    path, at, rows = written(tmp_path / "c.fa", held, 61), 0, []
    for name, seq in held.items():
        at += len(f">{name} some words > more\n")
        rows.append(f"{name}\t{len(seq)}\t{at}\t61\t62")
        at += len(seq) + -(-len(seq) // 61)
    (tmp_path / "c.fa.fai").write_text("\n".join(rows) + "\n")
    got = fasta.read_fasta_chunks(spark, path, 100)
    assert sorted(map(tuple, got.collect())) == chunks_of(held, 100) and got.rdd.getNumPartitions() == 5
    (tmp_path / "c.fa.fai").write_text("x\t30000\t22\t61\t62\n")
    with pytest.raises(Exception, match="index does not fit"):
        fasta.read_fasta_chunks(spark, path, 100).collect()


def test_windows_from_chunks(spark, tmp_path):
    held = records(random.Random(3))
    chunks = fasta.read_fasta_chunks(spark, written(tmp_path / "d.fa", held, 70), 100)
    w = spark.createDataFrame([(1, "long", 95, 305), (2, "chr5", 0, 250), (3, "chr1", 0, 1)], "id long, chrom string, start_bp long, end_bp long")
    got = {r["id"]: r["seq"] for r in genomic.fetch_windows(w, chunks, 100).collect()}
    assert got == {1: held["long"][95:305].upper(), 2: held["chr5"].upper(), 3: held["chr1"].upper()}


def test_text_before_a_header_and_missing_files(spark, tmp_path):
    (tmp_path / "e.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta_chunks(spark, str(tmp_path / "e.fa")).collect()
    (tmp_path / "f.fa").write_text("\n\n")
    assert fasta.read_fasta_chunks(spark, str(tmp_path / "f.fa")).collect() == []
    with pytest.raises(Exception, match="none.fa"):
        fasta.read_fasta_chunks(spark, str(tmp_path / "none.fa")).collect()


@pytest.mark.parametrize("width", [60, 50_000_000])
def test_a_record_of_50_mb_is_read_in_linear_time(tmp_path, width):
    """Also where it is one line; no row is longer than a chunk."""
    path = tmp_path / "g.fa"
    line = b"ACGTTGCA" * (min(width, 8_000_000) // 8 + 1)
    with path.open("wb") as f:
        f.write(b">x\n")
        for _ in range(50_000_000 // width if width == 60 else 6):
            f.write(line[:width] + (b"\n" if width == 60 else b""))
    began, letters = time.time(), 0
    for _, _, seq in fasta.FastaReader({"path": str(path)})._whole(fasta.Part(str(path))):
        assert len(seq) <= 65536
        letters += len(seq)
    assert letters > 45_000_000 and time.time() - began < 10


def test_audits_find_one_letter(spark):
    rng = random.Random(4)
    held = {n: "".join(rng.choices("ACGT", k=m)) for n, m in (("a", 1000), ("b", 1000), ("c", 990), ("d", 10), ("e", 10))}
    other = dict(held, b=held["b"][:777] + ("A" if held["b"][777] != "A" else "C") + held["b"][778:], c=held["c"] + "AC", f="ACG")
    del other["e"]
    table = lambda h: spark.createDataFrame([(n, i // 8, s[i : i + 8]) for n, s in h.items() for i in range(0, len(s), 8)], "component string, chunk long, seq string")
    x, y = table(held), table(other).withColumn("seq", F.lower("seq"))
    for fan in (2, 5, 1024):
        got = {r["component"]: r["verdict"] for r in audit.audit_components(x, y, fan).collect()}
        assert got == {"a": "same", "b": "letters", "c": "length", "d": "same", "e": "left only", "f": "right only"}
    assert sorted(map(tuple, audit.differing_chunks(x, y).collect())) == [("b", 97, 1, 1), ("c", 123, 6, 2)]
    assert audit.audit_components(x.limit(0), y.limit(0)).collect() == []
