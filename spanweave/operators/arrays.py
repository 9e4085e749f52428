"""Attribution arrays: alignment, overlap, distances, localisation, motif scans, in-silico mutagenesis."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_positions(a: Column) -> Column:
    return F.reverse(a)


def reverse_complement_matrix(m: Column) -> Column:
    """Rows reversed, channels A, C, G, T swapped."""
    return F.transform(F.reverse(m), F.reverse)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def top_positions(a: Column, k: int) -> Column:
    """The k positions of the largest magnitude, ties to the lower position."""
    ranked = F.sort_array(F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def top_overlap(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(top_positions(a, k), top_positions(b, k))) / k


def normalised_l1(a: Column, b: Column) -> Column:
    """Sum of differences over the sum of both magnitudes' means; null if both are zero."""
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), total(F.zip_with(a, b, lambda x, y: (F.abs(x) + F.abs(y)) / 2)))


def normalised_l2(a: Column, b: Column) -> Column:
    return F.try_divide(F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), F.sqrt(total(F.transform(a, lambda x: x * x))))


def largest_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mass_fraction(a: Column, start: int, end: int) -> Column:
    return F.try_divide(total(F.transform(F.slice(a, start + 1, end - start), F.abs)), total(F.transform(a, F.abs)))


def weighted_distance(a: Column, centre: float) -> Column:
    return F.try_divide(total(F.transform(a, lambda x, i: F.abs(x) * F.abs(i - F.lit(centre)))), total(F.transform(a, F.abs)))


def hit_localisation(a: Column, start: Column, end: Column, k: int, shifts: Iterable[int]) -> dict[str, Column]:
    """How a row's attribution sits on its hit [start, end): share of the mass, share of the hit among the k greatest
    positions, mean distance from the hit's middle by mass, mean share when the mass is rolled to the right by each of
    `shifts`, and the first over the last. Null where there is no mass, or no mass under the rolled hits."""
    mass, own = F.transform(a, F.abs), F.sequence(start, end - 1)
    whole, size, rolls = total(mass), F.size(a), F.array(*map(F.lit, shifts))
    share = F.try_divide(total(F.slice(mass, start + 1, end - start)), whole)
    recall = F.size(F.filter(top_positions(a, k), lambda i: (i >= start) & (i < end))) / (end - start)
    middle = (start + end - 1) / 2
    distance = F.try_divide(total(F.transform(mass, lambda x, i: x * F.abs(i - middle))), whole)
    at = lambda r: total(F.transform(own, lambda i: F.get(mass, F.pmod(i - r, size).cast("int"))))
    control = F.try_divide(total(F.transform(rolls, at)) / F.size(rolls), whole)
    return {"mass": share, "recall": recall, "distance": distance, "control": control, "enrichment": F.try_divide(share, control)}


def interval_localisation(a: Column, intervals: Column, k: int = 8) -> dict[str, Column]:
    """How a row's attribution sits on the union of half-open `intervals` (array of structs start, end): share of the k greatest
    values (signed; ties to the lower position) inside, share of the mass, mean inside less mean outside, and the average
    precision of the positions ranked by value (equal values are one threshold). Nothing inside: all null; nothing outside:
    no difference of means. Everything is a fold over the row's own array."""
    n = F.size(a)
    marked = F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i"), F.exists(intervals, lambda t: (i >= t["start"]) & (i < t["end"])).cast("int").alias("m")))
    ranked = F.array_sort(marked)
    inside = F.aggregate(marked, F.lit(0), lambda s, x: s + x["m"])
    some = inside > 0
    top = F.slice(ranked, 1, k)
    hits = F.aggregate(top, F.lit(0), lambda s, x: s + x["m"]) / F.size(top)
    added = lambda f: F.aggregate(marked, F.lit(0.0), lambda s, x: s + f(x))
    mass = F.try_divide(added(lambda x: F.abs(x["v"]) * x["m"]), added(lambda x: F.abs(x["v"])))
    gap = F.try_divide(added(lambda x: -x["v"] * x["m"]), inside) - F.try_divide(added(lambda x: -x["v"] * (1 - x["m"])), n - inside)
    state = lambda ap, tp, seen, met, last: F.struct(ap.alias("ap"), tp.alias("tp"), seen.alias("seen"), met.alias("met"), last.alias("last"))
    grown = lambda s: s["ap"] + F.coalesce(F.try_divide((s["tp"] - s["met"]) * s["tp"], s["seen"]), F.lit(0.0))

    def step(s: Column, x: Column) -> Column:
        new = ~s["last"].eqNullSafe(x["v"])
        return state(F.when(new, grown(s)).otherwise(s["ap"]), s["tp"] + x["m"], s["seen"] + 1.0, F.when(new, s["tp"]).otherwise(s["met"]), x["v"])

    zero = F.lit(0.0)
    precision = F.aggregate(ranked, state(zero, zero, zero, zero, F.lit(None).cast("double")), step, grown) / inside
    found = {"top_overlap": hits, "mass": mass, "gap": gap, "precision": precision}
    return {name: F.when(some, c) for name, c in found.items()}


def pwm_weights(counts: dict[str, list[float]], pseudocount: float = 0.8, background: float = 0.25) -> list[dict[str, float]]:
    """Log-odds per column and base."""
    width = len(counts["A"])
    return [{b: math.log2((counts[b][i] + pseudocount) / (sum(counts[x][i] for x in "ACGT") + 4 * pseudocount) / background) for b in "ACGT"} for i in range(width)]


def pwm_score(kmer: Column, pwm: list[dict[str, float]]) -> Column:
    score = F.lit(0.0)
    for i, column in enumerate(pwm):
        base = F.substring(kmer, i + 1, 1)
        part = F.lit(column["T"])
        for b in "CGA":
            part = F.when(base == b, F.lit(column[b])).otherwise(part)
        score = score + part
    return score


_LETTER_CODES = np.full(256, 4, np.int64)
_LETTER_CODES[[*b"ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]


def window_scores(letters: np.ndarray, pwm: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every window of coded letters, forward and reversed, rounded to nine digits; minus infinity where a
    letter is not A, C, G or T."""
    w, n = len(pwm), len(letters) - len(pwm) + 1
    ahead, back = np.zeros(n), np.zeros(n)
    for i, column in enumerate(pwm):
        ahead += np.array([column[b] for b in "ACGT"] + [-np.inf])[letters[i : i + n]]
        back += np.array([column[b] for b in "TGCA"] + [-np.inf])[letters[w - 1 - i : w - 1 - i + n]]
    return np.round(ahead, 9), np.round(back, 9)


def pwm_best_hits(df: DataFrame, id_col: str, seq: str, pwm: list[dict[str, float]]) -> DataFrame:
    """(id, start, strand, score, relative): the best window of either strand; ties to the lower start, then forward. `relative`:
    the score's place between the least and the most that the matrix allows, within 0 and 1. Sequences that are
    null, shorter than the matrix or without a window of A, C, G and T alone have no row. One pass, no shuffle."""
    low, high = sum(min(c.values()) for c in pwm), sum(max(c.values()) for c in pwm)

    def run(batches):
        for batch in batches:
            at, start, strand, score = [], [], [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                letters = _LETTER_CODES[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                if len(letters) < len(pwm):
                    continue
                ahead, back = window_scores(letters, pwm)
                best = np.maximum(ahead, back)
                i = int(best.argmax())
                if np.isfinite(best[i]):
                    at.append(k)
                    start.append(i)
                    strand.append("+" if ahead[i] >= back[i] else "-")
                    score.append(float(best[i]))
            relative = np.clip((np.array(score) - low) / ((high - low) or 1.0), 0.0, 1.0)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(strand, pa.string()), pa.array(score, pa.float64()), pa.array(relative, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "strand", "score", "relative"])

    rows = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, start int, strand string, score double, relative double")


def ism_effects(df: DataFrame, id_col: str, seq: str, pwm: list[dict[str, float]], at: int) -> DataFrame:
    """(id, pos, signed, magnitude) for every position: mean and mean magnitude of what the three substitutions take from
    the score of the window at `at`. Only the window's own columns change a score, so each is one difference of weights;
    positions outside it have no effect. One pass over each row, no mutant is built."""
    w = len(pwm)
    weight = F.array(*(F.create_map(*(F.lit(x) for b in "ACGT" for x in (b, column[b]))) for column in pwm))

    def effect(i: Column, base: Column) -> Column:
        column = F.try_element_at(weight, i - at + 1)
        return F.transform(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != base), lambda b: column[base] - column[b])

    pos = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base"))
    e = F.when(F.col("pos").between(at, at + w - 1), effect(F.col("pos"), F.col("base"))).otherwise(F.array(*[F.lit(0.0)] * 3))
    pos = pos.select("id", "pos", e.alias("e"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y) / F.size("e")
    return pos.select("id", "pos", mean(F.col("e")).alias("signed"), mean(F.transform("e", F.abs)).alias("magnitude"))


def mutants(df: DataFrame, id_col: str, seq: str) -> DataFrame:
    """(id, pos, base, mutant): every single substitution."""
    pos = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s"), F.posexplode(F.split(F.col(seq), "")).alias("pos", "own"))
    alt = pos.select("*", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base")).where("base <> own")
    return alt.select("id", "pos", "base", F.overlay("s", "base", F.col("pos") + 1).alias("mutant"))
