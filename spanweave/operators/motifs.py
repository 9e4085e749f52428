"""Motif edits and scans: substitutions that weaken a hit, and windows close to a consensus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def weakest_bases(pwm: list[dict[str, float]]) -> list[list[str]]:
    """Per column the bases by rising weight, ties in the order A, C, G, T."""
    return [sorted("ACGT", key=lambda b: (column[b], b)) for column in pwm]


def disrupting_base(pwm: list[dict[str, float]], strand: str, offset: int, base: str) -> str:
    """What a base of a hit becomes, by its offset from the hit's start on the forward strand: the weakest other base of the
    column that it meets, complemented where the hit is on the reverse strand."""
    column = offset if strand == "+" else len(pwm) - 1 - offset
    own = base if strand == "+" else _PAIR[base]
    other = next(b for b in weakest_bases(pwm)[column] if b != own)
    return other if strand == "+" else _PAIR[other]


def disrupt(hits: DataFrame, seq: str, pwm: list[dict[str, float]]) -> DataFrame:
    """`hits` (start, strand and the sequence) with `mutant`: every base of the hit replaced by `disrupting_base`, and
    `changed`: the positions. Other letters in a hit stay."""
    w = len(pwm)
    table = F.create_map(*(F.lit(x) for s in "+-" for i in range(w) for b in "ACGT" for x in (f"{s}{i}{b}", disrupting_base(pwm, s, i, b))))
    at = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.struct(i.alias("i"), F.substr(F.upper(seq), F.col("start") + i + 1, F.lit(1)).alias("b")))
    new = F.transform(at, lambda x: F.coalesce(F.try_element_at(table, F.concat("strand", x["i"].cast("string"), x["b"])), x["b"]))
    mutant = F.concat(F.substr(seq, F.lit(1), F.col("start")), F.array_join(new, ""), F.substr(seq, F.col("start") + w + 1))
    return hits.withColumn("mutant", mutant).withColumn("changed", F.sequence(F.col("start"), F.col("start") + w - 1))


def near_motif_scan(df: DataFrame, id_col: str, seq: str, motifs: list[str], most: int) -> DataFrame:
    """(id, start, end, motif, orientation, distance): windows within `most` substitutions of a motif (by its index) in either
    orientation (0 forward), each window once: the nearest, ties to the lower index, then forward. Motifs of one length
    share a window. Null and shorter sequences have none. One pass, no shuffle."""
    sides = [(len(m), i, o, np.frombuffer((m if o == 0 else _reversed(m)).upper().encode(), np.uint8)) for i, m in enumerate(motifs) for o in (0, 1)]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer((s or "").upper().encode("ascii", "replace"), np.uint8)
                for w in sorted({x[0] for x in sides}):
                    if len(letters) < w:
                        continue
                    windows = np.lib.stride_tricks.sliding_window_view(letters, w)
                    mine = [x for x in sides if x[0] == w]  # by index, then orientation, so that the first of equals is right
                    apart = np.array([(windows != x[3]).sum(1) for x in mine])
                    best, near = apart.argmin(0), apart.min(0)
                    for at in np.flatnonzero(near <= most).tolist():
                        ids.append(k)
                        rows.append((at, at + w, mine[best[at]][1], mine[best[at]][2], int(near[at])))
            columns = [pa.array([r[c] for r in rows], pa.int32()) for c in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=["id", "start", "end", "motif", "orientation", "distance"])

    rows = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, start int, end int, motif int, orientation int, distance int")


def _reversed(motif: str) -> str:
    return "".join(_PAIR[b] for b in reversed(motif.upper()))
