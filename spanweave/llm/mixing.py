"""Mixing sources to target weights: iterative proportional fitting of token weights to source, language and topic
marginals, then sampling of documents by calibrated probabilities.

Topics come from spherical k-means over hashed words, fitted on all documents and their whole texts. Tokens (words) are
summed per (source, language, topic); raking alternates over the three marginals on that table, in Spark, until all agree. The
raked value of a cell is the probability of its documents, so it never passes 1 and no document is repeated.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, fresh, tidy

DIMENSIONS = ("source", "lang", "topic")
TOPICS, BUCKETS = 8, 256
#: Default targets: each value's share of tokens to this power, normalised (1 leaves the corpus as it is).
POWER = 0.8
#: Share of all tokens to sample.
KEEP = 0.5
_CACHE = 500_000
#: Longer words (bytes) are not kept there.
_LONGEST = 64
#: Up to so many cells, tables are raked in one piece; larger ones in Spark.
FEW = 100_000


class _Buckets(dict):
    def __missing__(self, w: bytes) -> int:
        b = hashlib.blake2b(w, digest_size=1).digest()[0]
        if len(w) <= _LONGEST:
            if len(self) >= _CACHE:
                self.clear()
            self[w] = b
        return b


_buckets = _Buckets()


def _start() -> None:
    claim("mixing", _buckets.clear)


def counts_of(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed words, and the number of words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.uint8, len(words)), minlength=BUCKETS), len(words)


def _unit(column) -> np.ndarray:
    """Rows of length 1 of a column of packed counts; zeros where there are no words."""
    x = np.sqrt(np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BUCKETS).astype(float))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _draw(vectors: DataFrame, c: np.ndarray, n: int) -> np.ndarray | None:
    """The n-th centre, drawn from all documents in proportion to their distance from the nearest of the others (the
    k-means++ rule, by hashes of the vectors, so alike for any partitioning); None if none is apart."""

    def run(batches):
        best = None
        for batch in batches:
            col = batch.column(0)
            x = _unit(col)
            far = np.where(x.any(1), 1 - (x @ c.T).max(1, initial=0.0), 0.0)
            for i in np.flatnonzero(far > 1e-9):
                v = col[int(i)].as_py()
                u = (int.from_bytes(hashlib.blake2b(v, digest_size=7, salt=bytes([n])).digest(), "big") + 1) / 2.0**56
                best = min(best or (np.inf, b""), (-np.log(u) / round(float(far[i]), 9), v))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.binary())], names=["key", "v"])

    first = vectors.select("v").mapInArrow(run, "key double, v binary").agg(F.min(F.struct("key", "v")).alias("m")).select("m.v").first()[0]
    return None if first is None else _unit(pa.array([bytes(first)]))[0]


def topic_centroids(vectors: DataFrame, topics: int = TOPICS, rounds: int = 8) -> np.ndarray:
    """Fitted on all rows of `vectors` (v: packed counts); fewer topics if there are fewer different documents. A round
    sends the driver topics x BUCKETS sums, of whole numbers, so that their order does not matter."""
    c = np.zeros((0, BUCKETS))
    while len(c) < topics and (x := _draw(vectors, c, len(c))) is not None:
        c = np.vstack([c, x])
    if not len(c):
        return np.zeros((1, BUCKETS))
    for _ in range(rounds):

        def sums(batches, c=c):
            out = np.zeros((len(c), BUCKETS), np.int64)
            for batch in batches:
                x = _unit(batch.column(0))
                near = nearest(x, c)
                for j in np.unique(near):
                    out[j] += np.rint(x[near == j] * 2**20).astype(np.int64).sum(0)
            j, k = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(out[j, k])], names=["j", "k", "n"])

        new = np.zeros_like(c)
        for j, k, n in vectors.select("v").mapInArrow(sums, "j int, k int, n long").groupBy("j", "k").agg(F.sum("n")).collect():
            new[j, k] = n
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 0, new / np.maximum(size, 1e-300), c)  # a topic without documents stays
        if np.array_equal(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.round(x @ c.T, 12).argmax(1)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, topic, tokens) of every row; null source or language is the value ''. Text without words: topic 0."""

    def count(batches):
        _start()
        for batch in batches:
            found = [counts_of(t.as_py()) for t in batch.column(1)]
            v, tokens = [x.astype("<u4").tobytes() for x, _ in found], [n for _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(v, pa.binary()), pa.array(tokens, pa.int64())], names=["id", "source", "lang", "v", "tokens"])

    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), blank("source").alias("source"), blank("lang").alias("lang"))
    vectors = cut(df.mapInArrow(count, "id long, source string, lang string, v binary, tokens long"), "vectors")
    c = topic_centroids(vectors)

    def assign(batches):
        for batch in batches:
            topic = nearest(_unit(batch.column(3)), c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(topic, pa.int32()), batch.column(4)], names=["id", "source", "lang", "topic", "tokens"])

    return vectors.mapInArrow(assign, "id long, source string, lang string, topic int, tokens long")


def tempered(cells: DataFrame, by: str, power: float = POWER) -> DataFrame:
    """(value, target): shares of tokens to the given power, normalised over the values that have tokens."""
    sums = cells.groupBy(F.col(by).cast("string").alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0").select("value", F.pow("n", F.lit(power)).alias("n"))
    return cut(sums.join(F.broadcast(sums.agg(F.sum("n").alias("all"))), F.lit(True)).select("value", (F.col("n") / F.col("all")).alias("target")), "target")


def reachable(sums: DataFrame, target: DataFrame, want: float) -> DataFrame:
    """(value, most, wanted) of one dimension with sums (value, most): `want` tokens shared out by the targets. A value
    with fewer tokens than its share is wanted whole and the others make up for it. A value without target: 0."""
    v = cut(sums.join(target, "value", "left").select("value", "most", F.coalesce("target", F.lit(0.0)).alias("target")), "values")
    scale, full = want, -1
    while True:
        whole = F.col("target") * F.lit(scale) >= F.col("most")
        n, taken, rest = v.where("target > 0").agg(F.count_if(whole), F.sum(F.when(whole, F.col("most")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("target")))).first()
        if n == full or not rest:
            break
        scale, full = max(scale, (want - taken) / rest), n
    return cut(v.select("value", "most", F.least(F.col("most").cast("double"), F.col("target") * F.lit(scale)).alias("wanted")), "wanted")


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = 100, tolerance: float = 1e-3, few: int = FEW) -> DataFrame:
    """(source, lang, topic, probability): expected sampled tokens are `keep` of all, in shares that meet the targets.

    A target table holds (value, target), the targets of a dimension summing to 1. A probability is `keep` times one
    factor per dimension, at most 1. Each step scales the factors of one dimension by the ratio of wanted to expected
    tokens, so the other cells of a value make up for full ones. A value that a target lacks gets 0. A value with too
    few tokens is taken whole, its cells staying at 1, and the others of its dimension share what it lacks. Ends when no
    value of any dimension is off by more than `tolerance`; if the targets exclude each other, when ten rounds bring no
    gain, or after `rounds`, with a warning that gives what is left. Values without tokens stay at `keep`. Tables of `few`
    cells at most, each of their targets too, are raked as arrays; the steps are the same.
    """
    if max(t.limit(few + 1).count() for t in (cells, *targets.values())) <= few:
        return _rake_few(cells, targets, keep, rounds, tolerance)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    w = cells
    for by, target in targets.items():  # cells of values without target first: they leave fewer tokens to the others
        kept = target.where("target > 0").select("value", F.lit(True).alias(f"_{by}"))
        w = w.join(kept, F.col(by).cast("string") == F.col("value"), "left").drop("value")
    w = cut(w.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, sum((F.coalesce(f"_{by}", F.lit(False)).cast("int") for by in targets), F.lit(0)) == len(targets)).otherwise(F.lit(True)).alias("open")), "open")
    wanted = {}
    for by, target in targets.items():
        most = w.where("open").groupBy(F.col(by).cast("string").alias("value")).agg(F.sum("tokens").alias("most"))
        wanted[by] = reachable(most, target, keep * total)
        full = wanted[by].where("most > 0 and wanted >= most").select("value", F.lit(True).alias(f"_{by}"))
        w = w.join(full, F.col(by).cast("string") == F.col("value"), "left").drop("value")
    pinned = sum((F.coalesce(f"_{by}", F.lit(False)).cast("int") for by in targets), F.lit(0)) > 0
    w = cut(w.select(*DIMENSIONS, "tokens", (F.col("open") & pinned).alias("pinned"), F.when(F.col("open"), F.lit(keep)).otherwise(0.0).alias("weight")), "weights")
    p = F.when(F.col("pinned"), 1.0).otherwise(F.least(F.lit(1.0), F.col("weight")))

    def factors(by):
        # Pinned cells are given; the others share what is wanted beyond them.
        n = lambda on: F.sum(F.when(on, F.col("tokens") * p).otherwise(0.0))
        sums = w.groupBy(F.col(by).cast("string").alias("value")).agg(n(~F.col("pinned")).alias("n"), n(F.col("pinned")).alias("fixed"))
        left = F.greatest(F.col("wanted") - F.col("fixed"), F.lit(0.0))
        gap = F.abs(F.col("n") + F.col("fixed") - F.col("wanted")) / F.greatest("wanted", F.lit(1e-9))
        return sums.join(wanted[by], "value").select("value", F.when(F.col("n") > 0, left / F.col("n")).otherwise(1.0).alias("f"), F.when(F.col("most") > 0, gap).otherwise(0.0).alias("off"))

    off, best, since = 0.0, np.inf, 0
    for i in range(rounds + 1):
        off = max(factors(by).agg(F.max("off")).first()[0] or 0.0 for by in targets)
        since = 0 if off < 0.999 * best else since + 1
        best = min(best, off)
        if off <= tolerance or i == rounds or since == 10:
            break
        for by in targets:
            f = cut(factors(by), "factor")
            w = w.join(f, F.col(by).cast("string") == F.col("value"), "left").select(*DIMENSIONS, "tokens", "pinned", (F.col("weight") * F.coalesce("f", F.lit(1.0))).alias("weight"))
        w = cut(w, "weights")
    if off > tolerance:
        warnings.warn(f"raking ended with a marginal off by {off:.3g} of what is wanted", stacklevel=2)
    return w.select(*DIMENSIONS, p.alias("probability"))


def _rake_few(cells: DataFrame, targets: dict[str, DataFrame], keep: float, rounds: int, tolerance: float) -> DataFrame:
    """`rake` for cells and targets that fit in memory, a bounded number of rows."""
    rows = sorted(cells.select(*DIMENSIONS, "tokens").collect(), key=lambda r: tuple(map(str, r[:3])))
    tokens = np.array([r[3] for r in rows], float)
    want, still = keep * tokens.sum(), tokens > 0
    code, share = {}, {}
    for by, target in targets.items():
        values, code[by] = np.unique(np.array([str(r[by]) for r in rows], object).astype(str), return_inverse=True)
        given = {r[0]: float(r[1] or 0.0) for r in target.select("value", "target").collect()}
        share[by] = np.array([given.get(v, 0.0) for v in values])
        still &= share[by][code[by]] > 0 if len(rows) else still
    sums = lambda by, x: np.bincount(code[by], x, len(share[by]))
    wanted, most, pinned = {}, {}, np.zeros(len(rows), bool)
    for by in targets:
        m = most[by] = sums(by, np.where(still, tokens, 0.0))
        at, scale, full = share[by] > 0, want, -1
        while True:
            whole = at & (share[by] * scale >= m)
            rest = share[by][at & ~whole].sum()
            if whole.sum() == full or not rest:
                break
            scale, full = max(scale, (want - m[whole].sum()) / rest), whole.sum()
        wanted[by] = np.minimum(m, share[by] * scale)
        pinned |= ((m > 0) & (wanted[by] >= m))[code[by]]
    pinned &= still | (tokens <= 0)
    weight = np.where(still | (tokens <= 0), keep, 0.0)
    p = lambda: np.where(pinned, 1.0, np.minimum(1.0, weight))

    def off(by: str) -> float:
        gap = np.abs(sums(by, tokens * p()) - wanted[by]) / np.maximum(wanted[by], 1e-9)
        return float(gap[most[by] > 0].max(initial=0.0))

    left, best, since = 0.0, np.inf, 0
    for i in range(rounds + 1):
        left = max(map(off, targets)) if targets else 0.0
        since = 0 if left < 0.999 * best else since + 1
        best = min(best, left)
        if left <= tolerance or i == rounds or since == 10:
            break
        for by in targets:
            n, fixed = (sums(by, np.where(pinned == on, tokens * p(), 0.0)) for on in (False, True))
            weight = weight * np.where(n > 0, np.maximum(wanted[by] - fixed, 0.0) / np.where(n > 0, n, 1.0), 1.0)[code[by]]
    if left > tolerance:
        warnings.warn(f"raking ended with a marginal off by {left:.3g} of what is wanted", stacklevel=3)
    types = ", ".join(f"{c} {t}" for c, t in cells.select(*DIMENSIONS).dtypes)
    return cells.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(rows, p(), strict=True)], f"{types}, probability double")


def uniform(id_col: Column, seed: int = 17) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


@tidy
def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) for every row of `docs`.

    Expected sampled tokens meet the targets (default: `tempered` for each dimension). Sampling depends on the id and
    the seed alone, so rows of one id fare alike. A null id is never sampled. Empty table: no rows.
    """
    m = cut(measured(docs, id_col, text_col), "measured")
    cells = cut(m.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {by: tempered(cells, by) for by in DIMENSIONS}
    p = cut(rake(cells, targets, keep), "raked")
    joined = m.join(p, list(DIMENSIONS))
    return joined.select(F.col("id").alias("doc_id"), *DIMENSIONS, "tokens", "probability", (F.col("id").isNotNull() & (uniform(F.col("id"), seed) < F.col("probability"))).alias("sampled"))


@tidy
def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is sampled; all columns stay."""
    name = fresh("chosen")
    chosen = calibrated(docs, targets, keep, seed, id_col, text_col).where("sampled").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(chosen, F.col(id_col).cast("long") == F.col(name), "left_semi")
