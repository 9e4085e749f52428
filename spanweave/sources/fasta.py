"""A Spark data source for FASTA files of any size: rows of (name, chunk, seq), read as a stream.

    spark.dataSource.register(FastaChunks)
    spark.read.format("fasta_chunks").option("size", 65536).load("hdfs://.../genome.fa")

A plain file with an index beside it (`<path>.fai`) is cut into byte ranges at chunk borders and read by many tasks; other
files, and gzip files (.gz), are one task each, which holds one chunk at a time however long a record or a line is.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, chunk long, seq string"
_ARROW = pa.schema([("name", pa.string()), ("chunk", pa.int64()), ("seq", pa.string())])
_BLANK = b" \t\r\n\x0b\x0c"
#: Bytes asked for at once, and chunks that one task reads by the index.
_READ, _TOGETHER = 1 << 20, 64


@dataclass
class Part(InputPartition):
    """A whole file (`name` None), or chunks `first` to `last` - 1 of a record that the index describes."""

    path: str
    name: str | None = None
    first: int = 0
    last: int = 0
    length: int = 0
    offset: int = 0
    line_bases: int = 0
    line_width: int = 0

    def value(self):  # partitions travel as they are
        return self


def _opened(path: str):
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inside


def streamed(stream: io.BufferedIOBase, size: int) -> Iterator[tuple[str, int, str]]:
    """Chunks of `size` letters, upper-case; the last of a record may be shorter. A record without letters has none. Text before
    the first header is an error."""
    name, chunk, held, count, fresh = None, 0, [], 0, True
    while True:
        line = stream.readline(_READ)
        if not line or (fresh and line[:1] == b">"):
            if count:
                yield name, chunk, b"".join(held).decode("ascii", "replace")
            if not line:
                return
            while not line.endswith(b"\n") and (more := stream.readline(_READ)):
                line += more
            words = line[1:].split()
            name, chunk, held, count, fresh = (words[0].decode("utf-8", "replace") if words else ""), 0, [], 0, True
            continue
        fresh = line.endswith(b"\n")
        letters = line.translate(None, _BLANK).upper()
        if letters and name is None:
            raise ValueError("letters before the first header")
        at = 0
        while count + len(letters) - at >= size:
            taken = size - count
            held.append(letters[at : at + taken])
            yield name, chunk, b"".join(held).decode("ascii", "replace")
            held, count, chunk, at = [], 0, chunk + 1, at + taken
        if at < len(letters):
            held.append(letters[at:])
            count += len(letters) - at


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", 65536))
        if self.size < 1:
            raise ValueError("size must be positive")

    def partitions(self) -> list[Part]:
        system, inside = _opened(self.path)
        found = system.get_file_info(inside)
        if found.type == fs.FileType.Directory:
            files = [f.path for f in system.get_file_info(fs.FileSelector(inside)) if f.is_file and not f.path.endswith(".fai") and not f.base_name.startswith((".", "_"))]
            prefix = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
            return [p for f in sorted(files) for p in self._cut(system, f, prefix + f)]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return self._cut(system, inside, self.path)

    def _cut(self, system: fs.FileSystem, inside: str, path: str) -> list[Part]:
        if path.endswith(".gz") or system.get_file_info(inside + ".fai").type != fs.FileType.File:
            return [Part(path)]
        with system.open_input_stream(inside + ".fai") as f:
            rows = [line.split("\t") for line in f.read().decode().splitlines() if line.strip()]
        out = []
        for name, *numbers in rows:
            length, offset, bases, width = map(int, numbers[:4])
            chunks = -(-length // self.size)
            out += [Part(path, name, c, min(chunks, c + _TOGETHER), length, offset, bases, width) for c in range(0, chunks, _TOGETHER)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for name, chunk, seq in self._whole(part) if part.name is None else self._ranged(part):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([chunk], pa.int64()), pa.array([seq], pa.string())], schema=_ARROW)

    def _whole(self, part: Part) -> Iterator[tuple[str, int, str]]:
        system, inside = _opened(part.path)
        with system.open_input_stream(inside, compression=None, buffer_size=_READ) as raw:
            yield from streamed(io.BufferedReader(gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw, _READ), self.size)

    def _ranged(self, part: Part) -> Iterator[tuple[str, int, str]]:
        system, inside = _opened(part.path)
        byte = lambda base: part.offset + base // part.line_bases * part.line_width + base % part.line_bases
        with system.open_input_file(inside) as f:
            for chunk in range(part.first, part.last):
                first, last = chunk * self.size, min(part.length, (chunk + 1) * self.size)
                f.seek(byte(first))
                letters = f.read(byte(last - 1) + 1 - byte(first)).translate(None, _BLANK).upper()
                if len(letters) != last - first:
                    raise ValueError(f"{part.path}: the index does not fit at {part.name}, chunk {chunk}")
                yield part.name, chunk, letters.decode("ascii", "replace")


class FastaChunks(DataSource):
    """Options: path (any that pyarrow opens: local, hdfs, s3, gs), size (letters of a chunk, 65536)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 65536) -> DataFrame:
    """(chrom, chunk, seq) of a FASTA file or folder, the layout that `genomic.fetch_windows` joins."""
    spark.dataSource.register(FastaChunks)
    return spark.read.format("fasta_chunks").option("size", size).load(path).withColumnRenamed("name", "chrom")
