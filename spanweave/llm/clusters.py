"""Centroid clustering over whole numbers: float32 screening with rounding-error intervals, exact recomputation.

A round is one pass over the vectors. Within a task the products of vectors and centroids come from one float32 matrix
product; every product has an interval that provably holds the exact one. Centroids whose interval overlaps the lowest
are recomputed with whole numbers, ties going to the lowest number. Sums per centroid leave a task as at most
(components + 1) * centroids * limbs rows and are added up by Spark; the driver sees centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, tidy

#: Rows whose products are held at once.
CHUNK = 8192
#: Bits of a limb: sums of any size travel as limbs that add up within a long.
LIMB = 40
_LONGEST = 2**63 - 1
#: Unit roundoff of float32, and what is added to cover the roundoff of the float64 bounds themselves.
_U32, _SLACK = 2.0**-24, 2.0**-45
#: Norms beyond this could overflow float32 products: such rows are recomputed against every centroid.
_FLOAT32_SAFE = 2.0**62


def whole(rows: np.ndarray) -> np.ndarray:
    """Float64 rows of whole numbers as int64, or as Python's integers where a squared distance might leave 62 bits."""
    if not rows.size or float(np.abs(rows).max()) ** 2 * 4 * rows.shape[1] < 2.0**62:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


class Centroids:
    """`rows`: lists of Python integers. Assigns float64 rows of whole numbers."""

    def __init__(self, rows: list[list[int]]):
        self.exact = np.array(rows, object).reshape(len(rows), -1)
        self.approx = np.array([[float(x) for x in r] for r in rows]).reshape(self.exact.shape)
        self.safe = all(float(x) == x and abs(x) < 2**53 for r in rows for x in r)
        self.single = self.approx.astype(np.float32)
        self.square = (self.approx * self.approx).sum(1)
        self.norm = np.sqrt(self.square)
        self.small = bool(self.approx.size) and float(np.abs(self.approx).max()) ** 2 * 4 * self.approx.shape[1] < 2.0**62
        self.int64 = self.exact.astype(np.int64) if self.small else None

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (rows, centroids) on |c|^2 - 2 x.c, which differs from the squared distance by |x|^2.

        A float32 product of n terms in any order, of factors rounded to float32, is off by at most g |x||c| with
        g = (n + 2) u / (1 - (n + 2) u) (Cauchy-Schwarz over the terms' error bounds); what float64 adds is within _SLACK.
        """
        n = x.shape[1] + 2
        gamma = n * _U32 / (1 - n * _U32) * 1.001
        norm = np.sqrt((x * x).sum(1))
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.single.T).astype(float)
            reach = norm[:, None] * self.norm[None]
            middle, off = self.square[None] - 2 * product, 2 * gamma * reach + _SLACK * (self.square[None] + 2 * reach)
            low, high = middle - off, middle + off
        blind = ~(np.isfinite(low) & np.isfinite(high)) | (norm > _FLOAT32_SAFE)[:, None] | (self.norm > _FLOAT32_SAFE)[None]
        if not self.safe:
            blind[:] = True
        return np.where(blind, -np.inf, low), np.where(blind, np.inf, high)

    def squared_distances(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact distances of row i to centroid of[i]."""
        y = whole(x)
        d = y - (self.int64 if self.small and y.dtype != object else self.exact)[of]
        return (d * d).sum(1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Nearest centroid of every row (ties: the lowest number), and how many distances were recomputed."""
        low, high = self.intervals(x)
        listed = low <= high.min(1)[:, None]
        near = listed.argmax(1)
        row, of = np.nonzero(listed & (listed.sum(1) > 1)[:, None])
        if len(row):
            d = self.squared_distances(x[row], of)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(d, first)
            tied = np.flatnonzero(d == np.repeat(best, np.diff(np.r_[first, len(row)])))
            lead = tied[np.r_[True, row[tied][1:] != row[tied][:-1]]]
            near[row[lead]] = of[lead]
        return near, len(row)


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = batch.column("v")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dims)


def _limbs(total: int) -> list[tuple[int, int]]:
    """(limb, digit) with total = sum of digit * 2**(LIMB * limb); digits carry the sign, zeros are left out."""
    sign, rest, out, at = (-1 if total < 0 else 1), abs(total), [], 0
    while rest:
        digit = rest & ((1 << LIMB) - 1)
        if digit:
            out.append((at, sign * digit))
        rest >>= LIMB
        at += 1
    return out


def _sums(rows: list[list[int]], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = Centroids(rows), len(rows)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            x = _rows(batch, dims)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                near, _ = c.assign(part)
                y = whole(part)
                for j in np.unique(near):
                    mine = y[near == j]
                    count[j] += len(mine)
                    total[j] += mine.sum(0)  # int64 rows stay below 2**31 apiece, so CHUNK of them fit
        out = [(j, -1, 0, int(count[j])) for j in range(k) if count[j]]
        out += [(j, d, limb, digit) for j in range(k) for d in range(dims) for limb, digit in _limbs(int(total[j, d]))]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], ["cluster", "dim", "limb", "digit"])

    return run


def _assigned(rows: list[list[int]], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(rows)
        for batch in batches:
            x = _rows(batch, dims)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                near, _ = c.assign(part)
                d = c.squared_distances(part, near)
                d = d if d.dtype == np.int64 else np.array([min(int(y), _LONGEST) for y in d], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id")[at : at + CHUNK], pa.array(near.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return run


def _moved(v: DataFrame, rows: list[list[int]], dims: int) -> list[list[int]]:
    """Centroids after one round: floor of the mean of what is assigned; empty ones stay."""
    parts = v.mapInArrow(_sums(rows, dims), "cluster int, dim int, limb int, digit long")
    count, total = [0] * len(rows), [[0] * dims for _ in rows]
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("digit").alias("digit")).collect():  # centroids x components
        if r["dim"] < 0:
            count[r["cluster"]] = r["digit"]
        else:
            total[r["cluster"]][r["dim"]] += r["digit"] << (LIMB * r["limb"])
    return [[t // n for t in total[j]] if (n := count[j]) else rows[j] for j in range(len(rows))]


@tidy
def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): Lloyd's k-means, exact in whole numbers.

    Vectors with exactly `dims` components, none null or non-finite (also not after scaling), become floor(scale * x).
    The first centroids are the k vectors with the smallest sha256 of `seed:id`; ties: by the vector itself. Then `rounds`
    rounds of assignment (squared Euclidean distance; ties: the lowest number) and floor of the mean, and a last
    assignment. Fewer than k vectors: as many centroids as vectors. Repeated rows count as often as they come; a null id
    takes part, but starts a centroid only after all others. Distances are compared without bound; the columns saturate at
    the range of long. Empty table: no rows. `scale` must be a power of two, so that scaling is exact.

    The driver holds k * dims numbers, and so does every task; vectors are read from the shared folder in each round.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    spark = df.sparkSession
    x = F.col(vec_col).cast("array<double>")
    v = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(F.size("v") == dims)
    v = v.select("id", F.transform("v", lambda y: _floored(y, scale)).alias("v")).where("forall(v, y -> y is not null and not isnan(y) and abs(y) < double('Infinity'))")
    v = cut(v, "vectors")
    first = v.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    rows = [[int(y) for y in r["v"]] for r in first]
    if not rows:
        return _finished(spark, v.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], id_col)
    for _ in range(rounds):
        moved = _moved(v, rows, dims)
        if moved == rows:  # every further round would find the same
            break
        rows = moved
    return _finished(spark, cut(v.mapInArrow(_assigned(rows, dims), "id long, cluster int, distance long"), "assigned"), rows, id_col)


def _floored(x, scale: int):
    """floor(scale * x) as double; doubles from 2^53 on are whole already. Adding zero makes -0.0 and 0.0 one."""
    y = F.lit(float(scale)) * x
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)


def _finished(spark: SparkSession, found: DataFrame, rows: list[list[int]], id_col: str) -> DataFrame:
    """`found` with the sums of its cluster and of all, and the digest of its centroid. One row per centroid is broadcast."""
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(sums.values()), _LONGEST)
    told = [(j, min(sums.get(j, 0), _LONGEST), total, hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for j, r in enumerate(rows)]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
