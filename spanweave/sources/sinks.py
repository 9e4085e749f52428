"""Sinks with fixed columns; Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], by: str | None = None) -> None:
    """Gzip CSV with a header and fixed column order, in one folder per value of `by` if given."""
    w = df.select(columns).write.option("header", True).option("compression", "gzip")
    (w.partitionBy(by) if by else w).csv(path)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for the same rows in any order and layout; hash is the sum of row hashes modulo 2^64, so that
    repeated rows count."""
    row = F.xxhash64(*sorted(df.columns))
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.pmod(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(str(2**64)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(20,0)").alias("hash"))


def write_arrays(df: DataFrame, path: str) -> None:
    """Array columns as compressed Parquet, the archive format for attributions."""
    df.write.option("compression", "zstd").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, md5, sha256) of every file that `path` (a folder, a file, a glob) names. Spark lists the files without
    reading them; a task streams each of its files a megabyte at a time, so they may have any size. Opens what pyarrow opens;
    empty files have no row, as Spark's file sources pass over them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                local = name.startswith(("file:", "/"))
                system, inside = (fs.LocalFileSystem(), unquote(urlsplit(name).path)) if local else fs.FileSystem.from_uri(name)
                sums = hashlib.md5(), hashlib.sha256()
                with system.open_input_stream(inside, compression=None) as f:
                    while block := f.read(1 << 20):
                        for x in sums:
                            x.update(block)
                found.append([x.hexdigest() for x in sums])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], names=["path", "bytes", "md5", "sha256"])

    return files.mapInArrow(run, "path string, bytes long, md5 string, sha256 string")


def verified(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, expected, observed, passed): `expected` (name, sha256) against `observed` (path, sha256), by the last part of the
    path; a missing or unexpected file does not pass."""
    seen = observed.select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("observed"))
    both = expected.select("name", F.col("sha256").alias("expected")).join(seen, "name", "full")
    return both.withColumn("passed", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))
