"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k takes pieces of at most capacity // k tokens and always k of them to a bin, so the bin of a piece follows from
its number within the class alone and workers fill bins without talking to one another. A document is first cut into
whole sequences; the rest goes to its class if it (nearly) fills a slot there, else a piece of exactly the next smaller
slot is cut off and the remainder is treated alike. So padding stays small without any search for fitting pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, cut, tidy

#: Largest class, and the part of a slot that a piece may leave empty without being cut.
CLASSES, SLACK = 128, 1 / 64
#: Chunks whose ids are remembered, and the longest of them in characters.
_CHUNK_CACHE, _CHUNK_CHARS = 1_200_000, 48
#: Normaliser and pre-tokeniser, as the file states them, for which text may be tokenised chunk by chunk (`_Chunks`). Fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Runs that the tokeniser never merges across: letters, single digits, other signs (apostrophes are left to it).
_RUNS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def pieces_of(n: int, capacity: int, classes: int = CLASSES, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces that n tokens are cut into, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = min(capacity // rest, classes)
        slot = capacity // k
        if k == classes or slot - rest <= slack * slot:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= out[-1][0]
    return out


class _Chunks(dict):
    """Ids of chunks between white space, as little-endian bytes, if the tokeniser never merges across white space; whole
    texts are given to any other tokeniser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        marks = [x["content"] for x in said.get("added_tokens") or []]
        self.chunked = said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == _PRE_TOKENIZER and not said["post_processor"]
        self.chunked = self.chunked and said["model"]["type"] == "BPE" and all(x.startswith("<|") for x in marks)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _CHUNK_CACHE:
            self.clear()
        if (chunk.isascii() or max(chunk) < "\u0100") and "<|" not in chunk and "'" not in chunk:  # composed forms, simple lower case
            low = chunk.lower()
            if low != chunk:  # the tokeniser lower-cases anyway
                ids = self[low]
            elif not chunk.isalpha() and len(parts := _RUNS.findall(chunk)) > 1:  # it cuts between letters, digits and signs
                ids = b"".join(map(self.__getitem__, parts))
            else:
                ids = self.whole(chunk)
        else:
            ids = self.whole(chunk)
        if len(chunk) <= _CHUNK_CHARS:
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, signs to the tokeniser
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, _Chunks] = {}


def _chunks(path: str) -> _Chunks:
    claim("packing", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = _Chunks(path)
    return _loaded[path]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, worker int, place long"


def _cut_up(path: str, eos: int, capacity: int):
    names = [x.split()[0] for x in _PIECE.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in _PIECE.split(", ")]
    end = np.array([eos], "<u4").tobytes()

    def run(batches):
        chunks, worker, placed = _chunks(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(chunks.ids(text.as_py()) + end)
                n, start = len(ids) // 4, 0
                for length, k in pieces_of(n, capacity):
                    place = placed[k] = placed.get(k, -1) + 1
                    rows.append((doc.as_py(), start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, worker, place))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    return run


def gathered(open_bins: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(class, class whose bin takes it, offset there): incomplete last bins (class, tokens), at most one a class, put
    together first fit, longest first."""
    bins: list[list[int]] = []  # [class, tokens]
    out = []
    for k, n in sorted(open_bins, key=lambda x: (-x[1], x[0])):
        home = next((b for b in bins if b[1] + n <= capacity), None)
        if home is None:
            bins.append(home := [k, 0])
        out.append((k, home[0], home[1]))
        home[1] += n
    return out


@tidy
def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, eos: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer`: path of the tokenizer file on every executor. A null or empty text is the one id `eos`. Rows are
    independent: a repeated row is packed again. Each class has one incomplete last bin at most; these, CLASSES in number
    at most, are put together into common sequences. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(_cut_up(tokenizer, eos, capacity), _PIECE), "pieces")
    # Where each worker's pieces of a class begin in the numbering of that class: one row per worker and class.
    held = pieces.groupBy("k", "worker").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("k").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(held.select("k", "worker", before.alias("base")), "base")
    number = F.col("base") + F.col("place")
    placed = pieces.join(base, ["k", "worker"]).withColumn("number", number)
    # The last bin of a class is incomplete if its pieces are no multiple of k: a row per class, CLASSES at most.
    full = {r[0]: r[1] // r[0] * r[0] for r in held.groupBy("k").agg(F.sum("held")).collect()}
    known = spark.createDataFrame(sorted(full.items()), "k int, full long")
    last = placed.join(F.broadcast(known), "k").where("number >= full").groupBy("k").agg(F.sum("length")).collect()
    homes = gathered(sorted(map(tuple, last)), capacity)
    moved = spark.createDataFrame([(k, full[k], full[home] // home * 1024 + home, shift) for k, home, shift in homes], "k int, full long, home long, shift long")
    placed = placed.join(F.broadcast(moved), "k", "left")
    own, is_open = (F.floor(F.col("number") / F.col("k")).cast("long") * 1024 + F.col("k")), F.coalesce(F.col("number") >= F.col("full"), F.lit(False))
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", own.alias("bin"), (F.col("number") % F.col("k")).alias("slot"),
        F.when(is_open, F.col("home")).otherwise(own).alias("sequence_id"),
        F.when(is_open, F.col("shift")).otherwise(F.lit(0)).alias("shift"),
    )
    # At most k pieces share a bin.
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (offset + F.col("shift")).alias("offset"))
