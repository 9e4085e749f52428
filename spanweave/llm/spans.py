"""Labelled text spans: one Arrow pass over whole texts, and digest columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim

#: kind, start, end (code points, end exclusive), base (found by the fixed patterns).
Span = tuple[str, int, int, bool]
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_DDL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def _start() -> None:
    claim("spans", tuple)  # keeps nothing


def with_spans(docs: DataFrame, find: Callable[[str], Iterable[Span]], id_col: str, text_col: str, name: str = "doc_id") -> DataFrame:
    """(name, spans) for every row, `find` being applied to each whole text (null: empty)."""

    def run(batches):
        _start()
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t.as_py() or "")] for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(found, _TYPE)], names=[name, "spans"])

    df = docs.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"{name} {df.dtypes[0][1]}, spans {_DDL}")


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digests(found: DataFrame, kinds: Iterable[str], id_col: str = "doc_id") -> DataFrame:
    """id, n_<kind> per kind and base_sha256 over the base spans, spans over all."""
    return found.select(id_col, *(counted("spans", k).alias(f"n_{k}") for k in kinds), F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def masked(docs: DataFrame, find: Callable[[str], Iterable[Span]], text_col: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced by <KIND>; overlapping spans become one, named by the first. Nulls stay."""

    def run(series):
        _start()
        for s in series:
            yield s.map(lambda t: None if t is None else _mask(t, find(t)))

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))


def _mask(text: str, spans: Iterable[Span]) -> str:
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
