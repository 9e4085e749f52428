"""Readers for peak, interval and sequence files, as text scans with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import merge


def _numbered(text: DataFrame) -> DataFrame:
    """Lines (value, at: start of the split that they are read from) of one file with their numbers: the place within the
    split, which its task knows, and the lines of the splits before, one count per split."""
    task = F.spark_partition_id()
    placed = text.select("value", "at", task.alias("task"), F.monotonically_increasing_id().alias("i"))
    first = placed.groupBy("task", "at").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(first.select("task", "at", "first", before.alias("before")))  # a row per split
    return placed.join(starts, ["task", "at"]).select("value", (F.col("i") - F.col("first") + F.col("before") + 1).alias("row_number"))


def _lines(spark: SparkSession, path: str, accession: str) -> DataFrame:
    """Numbered lines of one file, blank and comment lines counted but left out."""
    text = _numbered(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at")))
    kept = (F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")
    return text.where(kept).select(F.lit(accession).alias("accession"), "row_number", F.split("value", "\t").alias("f"))


def _field(i: int, kind: str) -> Column:
    return F.get("f", F.lit(i)).cast(kind)


def _strict(df: DataFrame, least: int) -> DataFrame:
    bad = (F.size("f") < least) | (F.col("start_bp") < 0) | (F.col("end_bp") <= F.col("start_bp"))
    return df.withColumn("start_bp", F.when(bad, F.raise_error(F.concat(F.lit("bad interval in line "), F.col("row_number").cast("string")))).otherwise(F.col("start_bp")))


def read_narrowpeak(spark: SparkSession, path: str, accession: str, invalid_summit: str = "error") -> DataFrame:
    """Peaks of one narrowPeak file (at least 10 columns); summits outside the peak raise an error or, `skip`, drop the row."""
    p = _lines(spark, path, accession).select("*", F.get("f", F.lit(0)).alias("chrom"), _field(1, "long").alias("start_bp"), _field(2, "long").alias("end_bp"), _field(4, "double").alias("score"), _field(6, "double").alias("signal"), (_field(1, "long") + _field(9, "long")).alias("summit"))
    p = _strict(p, 10)
    inside = (F.col("summit") >= F.col("start_bp")) & (F.col("summit") < F.col("end_bp"))
    p = p.where(inside) if invalid_summit == "skip" else p.withColumn("summit", F.when(inside, F.col("summit")).otherwise(F.raise_error(F.lit("summit outside its peak"))))
    return p.drop("f").withColumn("sample_id", F.concat_ws(":", "accession", "row_number"))


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    p = _lines(spark, path, "").select("*", F.get("f", F.lit(0)).alias("chrom"), _field(1, "long").alias("start_bp"), _field(2, "long").alias("end_bp"))
    return _strict(p, 3).select("chrom", "start_bp", "end_bp")


def read_merged_bed3(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_bp, end_bp): the strict intervals of a BED file, overlapping and touching ones put together."""
    return merge(read_bed3(spark, path)).select("chrom", "start_bp", "end_bp")


def read_accessibility(spark: SparkSession, paths: dict[str, str], kind: str) -> DataFrame:
    """Accessible peaks of several accessions (accession to path) as one table, `kind` narrowPeak (peaks with a summit outside are
    skipped) or hotspot; sorted by start, end, line number and accession."""
    if kind not in ("narrowPeak", "hotspot"):
        raise ValueError("kind is narrowPeak or hotspot")
    columns = ("accession", "row_number", "chrom", "start_bp", "end_bp", "signal", "summit")
    each = [(read_narrowpeak(spark, p, a, "skip") if kind == "narrowPeak" else read_hotspots(spark, p, a)).select(*columns) for a, p in sorted(paths.items())]
    return reduce(DataFrame.unionByName, each).orderBy("start_bp", "end_bp", "row_number", "accession")


def read_hotspots(spark: SparkSession, path: str, accession: str) -> DataFrame:
    """Eight-column accessibility file; invalid rows are skipped; the summit is absolute."""
    p = _lines(spark, path, accession).where(F.size("f") >= 8).select("accession", "row_number", F.get("f", F.lit(0)).alias("chrom"), _field(1, "long").alias("start_bp"), _field(2, "long").alias("end_bp"), _field(4, "double").alias("signal"), _field(6, "long").alias("summit"))
    return p.where("start_bp >= 0 and end_bp > start_bp and summit >= start_bp and summit < end_bp")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) with upper-case sequences; name is the first word of the header. For files of many records: each is one row,
    and a record begins with > at the start of a line."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    value = F.regexp_replace("value", "^>", "")
    head = F.substring_index(value, "\n", 1)
    return records.select(F.split(head, r"\s+")[0].alias("name"), F.upper(F.regexp_replace(F.substr(value, F.length(head) + 1), r"\s", "")).alias("seq"))


def read_table(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """CSV (plain or gzip) with a header and the given columns; another header or a value of another type is an error.
    `where` selects rows."""
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")
    return rows.where(where) if where else rows


def read_folds(spark: SparkSession, path: str, schema: str, folds: list[str], split: str = "train") -> DataFrame:
    """The rows that are in `split` in any of the fold columns."""
    return read_table(spark, path, schema, " or ".join(f"`{f}` = '{split}'" for f in folds))


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """CSV files of many runs as one table, with `run`: the folder that a file lies in."""
    rows = read_table(spark, glob, schema)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Array columns of a Parquet archive."""
    return spark.read.parquet(path).select(*columns)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases long, line_width long")


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    """(matrix_id, pos, base, n) of a matrix JSON."""
    j = spark.read.schema("matrix_id string, pfm struct<A:array<double>,C:array<double>,G:array<double>,T:array<double>>").json(path, multiLine=True)
    return j.select("matrix_id", F.explode(F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.col(f"pfm.{b}"))))).alias("base", "n")).select("matrix_id", "base", F.posexplode("n").alias("pos", "n"))


def read_assembly_report(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, role string, molecule string, kind string, genbank string, relationship string, refseq string, unit string, length long, ucsc string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema).where("role = 'assembled-molecule' and ucsc rlike '^chr([1-9]|1[0-9]|2[0-2])$'")


def chunked(fasta: DataFrame, size: int = 65536) -> DataFrame:
    """(chrom, chunk, seq): sequences in chunks of fixed size, the layout that windows are fetched from."""
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size)))
    return fasta.where(F.length("seq") > 0).select(F.col("name").alias("chrom"), "seq", n.alias("chunk")).select("chrom", "chunk", F.expr(f"substring(seq, cast(chunk * {size} + 1 as int), {size})").alias("seq"))


def fetch_windows(windows: DataFrame, chunks: DataFrame, size: int = 65536, id_col: str = "id") -> DataFrame:
    """(id, seq) for every window (id, chrom, start_bp, end_bp); an error for empty windows, unknown names and windows that
    reach beyond their sequence."""
    said = F.concat(F.lit("window out of bounds: "), F.coalesce("chrom", F.lit("null")), F.lit(":"), F.col("start_bp").cast("string"), F.lit("-"), F.col("end_bp").cast("string"))
    ok = (F.col("start_bp") >= 0) & (F.col("end_bp") > F.col("start_bp"))
    w = windows.select(F.col(id_col).alias("id"), "chrom", F.when(ok, F.col("start_bp")).otherwise(F.raise_error(said).cast("long")).alias("start_bp"), "end_bp")
    need = w.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_bp") / size), F.floor((F.col("end_bp") - 1) / size))))
    got = need.join(chunks, ["chrom", "chunk"], "left").groupBy("id", "chrom", "start_bp", "end_bp").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: F.coalesce(x["seq"], F.lit(""))), "")
    length = (F.col("end_bp") - F.col("start_bp")).cast("int")
    seq = joined.substr((F.col("start_bp") - F.col("c")[0]["chunk"] * size + 1).cast("int"), length)
    return got.select(F.col("id").alias(id_col), F.when(F.length(seq) == length, seq).otherwise(F.raise_error(said)).alias("seq"))
