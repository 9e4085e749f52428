"""Exact top-k by inner product (Voronoi kNN join) and approximate nearest neighbours (inverted multi-index).

Both share the local step (`block_join`): a block's data are dealt into parts of bounded size and the queries that ask for it into
slices; every part meets every slice once and returns the best k of each query, so no task holds more than that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

#: Rows of a part of a block, queries of a slice, rows scored at once.
PART, SLICE, CHUNK = 16_384, 1024, 4096
#: Most pivots, most centroids of a half, and vectors (first by hash of the id) that both are fitted on.
PIVOTS, CENTROIDS, SAMPLE = 512, 256, 4096


def _matrix(col) -> np.ndarray:
    rows = list(col)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def _finite(v: str) -> str:
    return f"forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, v: array<double>): without nulls, non-finite components and, unless `zero`, zero vectors; of the commonest
    length only (ties: the shorter), as others have no product with it. Repeated rows of an id: one of them."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and size(v) > 0").where(_finite("v"))
    if not zero:
        v = v.where("exists(v, x -> x <> 0)")
    length = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    v = v.where(F.size("v") == (length[0] if length else 0))
    return v.groupBy("id").agg(F.min("v").alias("v"))


def sample_of(vectors: DataFrame, most: int = SAMPLE) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "v").collect()
    return np.array([r[1] for r in sorted(rows)], float)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means on a bounded sample; fewer centroids if there are fewer different rows."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def block_join(data: DataFrame, asked: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], score: str) -> DataFrame:
    """Best k per query, block and part. data: block, id, vec, ...; asked: block, id, vec, ...; kernel(queries, data) ->
    (query_id, vec_id, score). Data are copied once per slice of the queries that ask for their block, so a block that
    nobody asks for goes nowhere. Blocks are few: one per pivot or centroid."""
    spark = data.sparkSession
    size, wanted = ({r[0]: r[1] for r in x.groupBy("block").agg(F.count(F.lit(1))).collect()} for x in (data, asked))
    plan = [(b, -(-size[b] // PART), -(-n // SLICE)) for b, n in sorted(wanted.items()) if b in size]
    dealt = F.broadcast(spark.createDataFrame(plan, "block int, parts int, slices int"))
    share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(dealt, "block").select(*data.columns, share("parts").alias("part_no"), each("slices").alias("slice_no"))
    right = asked.join(dealt, "block").select(*asked.columns, share("slices").alias("slice_no"), each("parts").alias("part_no"))

    def solve(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype={"long": "int64", "double": "float64"}[score])})
        return kernel(q, d)

    keys = ["block", "part_no", "slice_no"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    order = F.desc("score") if largest else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# --- exact top-k -----------------------------------------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as int64: in doubles, in int64 or in Python's integers, by what is exact;
    beyond the range of int64 they saturate."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best_products(q: pd.DataFrame, d: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k highest products of each query with rows of other ids; ties: smaller id."""
    a, b, ids = _matrix(q["vec"]), _matrix(d["vec"]), d["id"].to_numpy()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(b), CHUNK):
        s, own = products(a, b[at : at + CHUNK]), ids[at : at + CHUNK]
        for qid, row in zip(q["id"], s, strict=True):
            top = np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)]) if len(row) > k + 1 else np.arange(len(row))
            top = top[own[top] != qid]
            top = top[np.lexsort((own[top], -row[top].astype(object) if row.min() == -(2**63) else -row[top]))[:k]]
            kept.append((np.full(len(top), qid), own[top], row[top]))
    out = pd.DataFrame({c: np.concatenate([x[j] for x in kept]) for j, c in enumerate(("query_id", "vec_id", "score"))})
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)


def _floored(x, scale: int):
    """floor(scale * x) as double. Doubles from 2^53 on are whole; F.floor would pass them through long."""
    y = F.lit(float(scale)) * x
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


class _Groups:
    """Query groups of a Voronoi kNN join, and the distance bounds that say which data a group needs.

    pivots (rows); nearest: per pivot the distances of its k + 1 nearest data; queries: per pivot (count, largest
    distance of a query). A group is a pivot's queries with those of the nearest other pivots, up to SLICE of them.
    """

    def __init__(self, pivots: np.ndarray, nearest: dict[int, list[float]], queries: dict[int, tuple[int, float]], k: int):
        self.cells = np.array(sorted(queries), int)
        self.p = pivots[self.cells]
        self.radius = np.array([queries[c][1] for c in self.cells], float)
        size = np.sqrt((self.p * self.p).sum(1))
        # Every data row near its pivot gives each query cell a product that all its queries reach.
        away = np.array([a for c in sorted(nearest) for a in nearest[c]], float)
        home = pivots[np.array([c for c in sorted(nearest) for _ in nearest[c]], int)]
        norm = np.sqrt((home * home).sum(1))
        low = self.p @ home.T - size[:, None] * away[None] - self.radius[:, None] * (norm + away)[None]
        self.least = np.sort(low, axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(self.cells), -np.inf)
        self.group_of: dict[int, int] = {}
        apart = squared(self.p, self.p)
        order = np.argsort([-queries[c][0] for c in self.cells], kind="stable")
        members: list[list[int]] = []
        for i in order:
            if int(i) in self.group_of:
                continue
            members.append([])
            held = 0
            for j in np.argsort(apart[i], kind="stable"):
                n = queries[self.cells[j]][0]
                if int(j) not in self.group_of and (j == i or held + n <= SLICE):
                    self.group_of[int(j)] = len(members) - 1
                    members[-1].append(int(j))
                    held += n
        self.order = np.array([j for m in members for j in m], int)
        self.starts = np.cumsum([0, *map(len, members)])[:-1]
        self.by_cell = {int(self.cells[j]): g for j, g in self.group_of.items()}

    def needed(self, x: np.ndarray) -> np.ndarray:
        """(rows, groups): whether a query of the group may have the row among its best."""
        mid, swing = x @ self.p.T, np.sqrt((x * x).sum(1))[:, None] * self.radius[None]
        high = mid + swing + 1e-9 * (np.abs(mid) + swing + np.abs(self.least, where=np.isfinite(self.least), out=np.zeros_like(self.least))) + 1e-6
        return np.logical_or.reduceat((high >= self.least)[:, self.order], self.starts, axis=1)


@tidy
def top_inner_products(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x) per query, its own row excluded.

    Queries and data are grouped by their nearest pivot. From summaries (per pivot the k + 1 nearest data, the count and
    the radius of the queries) follows for every query group a product that the k best of all its queries reach; a data
    row is copied to just those groups where its product with some query may be that high, and each group is solved by
    itself. `pivots`: default a quarter of the root of the number of vectors, 16 to PIVOTS. Ties: smaller vec_id.
    Vectors that are null, hold null or non-finite components (also after scaling) or have another length than most take
    no part; repeated rows of an id: one of them; fewer than k candidates: all. Scores are exact at any size and saturate at the range of
    long. Empty table: no rows.
    """
    v = valid_vectors(df, id_col, vec_col, zero=True)
    v = v.select("id", F.transform("v", lambda x: _floored(x, scale)).alias("v")).where(_finite("v"))
    v = cut(v, "vectors")
    sample = sample_of(v)
    if not len(sample):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    p = centroids(sample, pivots or min(PIVOTS, max(16, math.isqrt(v.count()) // 4)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
            cell = squared(x, p).argmin(1)
            away = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pd.DataFrame({"id": f["id"], "vec": [r.tobytes() for r in x], "cell": cell.astype("int32"), "away": away})

    data = cut(v.mapInPandas(assign, "id long, vec binary, cell int, away double"), "assigned")
    queries = data.where(is_query(F.col("id")))
    asked = {r[0]: (r[1], r[2]) for r in queries.groupBy("cell").agg(F.count(F.lit(1)), F.max("away")).collect()}
    if not asked:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("cell").orderBy("away", "id"))
    nearest: dict[int, list[float]] = {}
    for cell, away in data.select("cell", "away", first.alias("n")).where(F.col("n") <= k + 1).select("cell", "away").collect():
        nearest.setdefault(cell, []).append(away)
    groups = _Groups(p, nearest, asked, k)

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                row, group = np.nonzero(groups.needed(_matrix(f["vec"])))
                yield pd.DataFrame({"block": group.astype("int32"), "id": f["id"].to_numpy()[row], "vec": f["vec"].to_numpy()[row]})

    copies = cut(data.select("id", "vec").mapInPandas(copy, "block int, id long, vec binary"), "copies")
    place = F.broadcast(df.sparkSession.createDataFrame(sorted(groups.by_cell.items()), "cell int, block int"))
    found = block_join(copies, queries.join(place, "cell").select("block", "id", "vec"), lambda q, d: best_products(q, d, k), "long")
    return best(found, k, True)


# --- approximate nearest neighbours ----------------------------------------------------------------------------------


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids (i, j) by growing d1[i] + d2[j], with a heap (multi-sequence algorithm)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(o1[i]), int(o2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (float(d1[o1[a]] + d2[o2[b]]), a, b))


def visit_share(sample: np.ndarray, halves: list[np.ndarray], k: int, recall: float, tries: int = 128) -> float:
    """Share of the vectors that a query must visit for `recall`, measured on the sample itself."""
    cut_at = halves[0].shape[1]
    n = len(sample)
    codes = [squared(s, c).argmin(1) for s, c in zip((sample[:, :cut_at], sample[:, cut_at:]), halves, strict=True)]
    cell = codes[0] * len(halves[1]) + codes[1]
    count = np.bincount(cell, minlength=len(halves[0]) * len(halves[1]))
    shares = []
    for i in range(0, n, max(1, n // tries)):
        d = squared(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        true = np.argsort(d)[: min(k, n - 1)]
        summed = (squared(sample[i : i + 1, :cut_at], halves[0])[0][:, None] + squared(sample[i : i + 1, cut_at:], halves[1])[0][None]).ravel()
        order = np.argsort(summed, kind="stable")
        reach = np.empty(len(order))
        reach[order] = np.cumsum(count[order])
        shares += (reach[cell[true]] / n).tolist()
    return float(min(1.0, np.quantile(shares, recall))) if shares else 1.0


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes (columns) of the sample's covariance, dealt to the two halves so that both spread alike."""
    value, axis = np.linalg.eigh(np.atleast_2d(np.cov(sample, rowvar=False)) if len(sample) > 1 else np.eye(sample.shape[1]))
    half, sums, sides = (sample.shape[1] + 1) // 2, [0.0, 0.0], ([], [])
    for i in np.argsort(-value, kind="stable"):
        side = 0 if len(sides[1]) == sample.shape[1] - half or len(sides[0]) < half and sums[0] <= sums[1] else 1
        sides[side].append(i)
        sums[side] += np.log(max(value[i], 1e-300))
    return axis[:, sides[0] + sides[1]]


@tidy
def multi_index_search(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance, its own row excluded, exact distances.

    Vectors are turned so that both halves spread alike; each half is quantised by its own `cells` centroids, so the index
    has cells^2 entries (default: an eighth of the root of the number of vectors, 8 to CENTROIDS, so an entry holds some
    64 vectors until CENTROIDS is met). A query walks the pairs of centroids by summed distance until the entries seen
    hold the share of all vectors that reaches `recall` on the sample the centroids were fitted on (structured data need
    little, unstructured data much), and at least 20 k vectors; those are reranked with the original vectors. Entries are
    stored by the first half's centroid, split when hot. Ties: smaller vec_id. Null and zero vectors, those with null or
    non-finite components or another length than most take no part; repeated rows of an id: one of them; one-dimensional
    vectors have an empty second half. Fewer than k candidates: all. Empty: no rows.
    """
    v = cut(valid_vectors(df, id_col, vec_col, zero=False), "vectors")
    sample = sample_of(v)
    if not len(sample):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = cells or min(CENTROIDS, max(8, math.isqrt(v.count()) // 8))
    turn = rotation(sample)
    sample = sample @ turn
    half = (sample.shape[1] + 1) // 2
    fitted = [centroids(sample[:, :half], cells), centroids(sample[:, half:], cells)]
    share = visit_share(sample, fitted, k, recall)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
            y = x @ turn
            code = [squared(h, c).argmin(1).astype("int32") for h, c in zip((y[:, :half], y[:, half:]), fitted, strict=True)]
            yield pd.DataFrame({"id": f["id"], "vec": [r.tobytes() for r in x], "block": code[0], "entry": code[1]})

    data = cut(v.mapInPandas(assign, "id long, vec binary, block int, entry int"), "coded")
    held = {(r[0], r[1]): r[2] for r in data.groupBy("block", "entry").agg(F.count(F.lit(1))).collect()}  # cells^2 rows at most
    total = sum(held.values())
    enough = max(20 * k, math.ceil(share * total))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for qid, vec in zip(f["id"], f["vec"], strict=True):
                x = np.frombuffer(vec)[None] @ turn
                seen, entries = 0, {}
                for i, j in traverse(squared(x[:, :half], fitted[0])[0], squared(x[:, half:], fitted[1])[0]):
                    if n := held.get((i, j)):
                        entries.setdefault(i, []).append(j)
                        seen += n
                        if seen > enough:
                            break
                out += [(qid, vec, i, js) for i, js in entries.items()]
            yield pd.DataFrame(out, columns=["id", "vec", "block", "entries"])

    def kernel(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        a, out = _matrix(q["vec"]), []
        for start in range(0, len(d), CHUNK):
            part = d.iloc[start : start + CHUNK]
            b, ids, entry = _matrix(part["vec"]), part["id"].to_numpy(), part["entry"].to_numpy()
            rough = squared(a, b)
            for i, (qid, js) in enumerate(zip(q["id"], q["entries"], strict=True)):
                at = np.flatnonzero(np.isin(entry, js) & (ids != qid))
                if len(at) > k:
                    r = rough[i][at]
                    least = np.partition(r, k - 1)[k - 1]
                    at = at[r <= least + 1e-9 * (1 + (a[i] ** 2).sum() + (b[at] ** 2).sum(1).max())]
                exact = np.sqrt(((b[at] - a[i]) ** 2).sum(1))
                order = np.lexsort((ids[at], exact))[:k]
                out.append((np.full(len(order), qid), ids[at][order], exact[order]))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("query_id", "vec_id", "score"))})

    asked = data.where(is_query(F.col("id"))).select("id", "vec").repartition(max(1, min(64, total // 4096 + 1)), "id")
    asked = cut(asked.mapInPandas(walk, "id long, vec binary, block int, entries array<int>"), "asked")
    return best(block_join(data.select("block", "id", "vec", "entry"), asked, kernel, "double"), k, False)
