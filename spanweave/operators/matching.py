"""Binning, matching without replacement, deterministic sampling, chromosome splits."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .stats import cumulated


def quantile_edges(df: DataFrame, by: list[str], value: str, bins: int = 10) -> DataFrame:
    """Per group the bins + 1 edges, linearly interpolated."""
    return df.groupBy(*by).agg(F.expr(f"percentile({value}, array({', '.join(str(i / bins) for i in range(bins + 1))}))").alias("edges"))


def quantile_of(value: Column, edges: Column, bins: int = 10) -> Column:
    """Number of inner edges that are not above the value."""
    return F.size(F.filter(F.slice(edges, 2, bins - 1), lambda e: e <= value)).cast("int")


def match_strata(left: DataFrame, right: DataFrame, strata: list[str], left_order: list, right_order: list) -> DataFrame:
    """The i-th of `left` with the i-th of `right` in each stratum; columns prefixed l_ and r_."""
    n = lambda df, side, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).select(*strata, "_n", *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in strata))
    return n(left, "l", left_order).join(n(right, "r", right_order), [*strata, "_n"])


#: Rows of a stretch of a stratum that are matched together, about.
STRETCH = 1 << 16


def _matched(rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Greedy matching inside one stretch. `rows`: v, id, asks; `bounds`: the pool's nearest rows outside (lo, hi: v, id), which
    stay available. `crosses`: -1 or 1 where the nearest row lies outside, below or above."""
    pool = rows[~rows["asks"]].sort_values(["v", "id"], kind="stable")
    asking = rows[rows["asks"]].sort_values(["v", "id"], kind="stable")
    ends = [(x["v"], x["id"]) if x is not None else None for x in (bounds["lo"].iloc[0], bounds["hi"].iloc[0])] if len(bounds) else [None, None]
    value, name = pool["v"].to_numpy(), pool["id"].to_list()
    n = len(value)
    below, above = list(range(n + 1)), list(range(n + 1))  # next free place at or below (shifted by one) and at or above

    def find(parent: list[int], k: int) -> int:
        root = k
        while parent[root] != root:
            root = parent[root]
        while parent[k] != root:
            parent[k], k = root, parent[k]
        return root

    out = []
    for v, i, at in zip(asking["v"], asking["id"], np.searchsorted(value, asking["v"].to_numpy(), "left").tolist(), strict=True):
        low, high = find(below, at) - 1, find(above, at)
        options = [(abs(value[k] - v), name[k], k, 0) for k in (low, high) if 0 <= k < n]
        if low < 0 and ends[0]:
            options.append((abs(ends[0][0] - v), ends[0][1], -1, -1))
        if high >= n and ends[1]:
            options.append((abs(ends[1][0] - v), ends[1][1], -1, 1))
        if not options:
            continue
        _, mate, k, crosses = min(options, key=lambda x: x[:2])
        if not crosses:
            below[k + 1], above[k] = k, k + 1
        out.append((i, mate, float(v), float(value[k]) if not crosses else float("nan"), crosses))
    return pd.DataFrame(out, columns=["ask", "mate", "ask_v", "mate_v", "crosses"])


def nearest_match(left: DataFrame, right: DataFrame, stratum: str, value: str, id_col: str = "id", stretch: int = STRETCH) -> DataFrame:
    """Greedy nearest matching without replacement inside strata: the smaller side asks, by rising value, then id, and takes
    the nearer of two free rows, the last below its value and the first from it on; ties to the smaller id. Null values and
    null strata take no part.

    A stratum is cut by value into stretches that are matched by themselves, with the nearest rows outside on offer. Where
    nobody takes one of those, the stretches did not compete: the others only had fewer rows to offer, so the result is
    that of the whole stratum. Neighbours of which one reached into the other are joined and matched again, until none does.
    """
    out, sizes, _ = in_stretches(left, right, stratum, value, id_col, stretch)
    out = out.join(sizes, "s")
    pick = lambda own, other: F.when(F.col("left_asks"), F.col(own)).otherwise(F.col(other))
    return out.select(pick("ask", "mate").alias("left_id"), pick("mate", "ask").alias("right_id"), pick("ask_v", "mate_v").alias("left_value"), pick("mate_v", "ask_v").alias("right_value"))


def in_stretches(left: DataFrame, right: DataFrame, stratum: str, value: str, id_col: str, stretch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, which side asks per stratum, rows with their last stretch) of `nearest_match`."""
    kind = dict(left.dtypes)[id_col]
    side = lambda df, is_left: df.select(F.col(stratum).alias("s"), F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"), F.lit(is_left).alias("is_left"))
    rows = side(left, True).union(side(right, False)).where("s is not null and v is not null and id is not null")
    sizes = rows.groupBy("s").agg((F.count_if("is_left") <= F.count_if(~F.col("is_left"))).alias("left_asks"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    dealt = rows.join(sizes, "s").select("s", "id", "v", "is_left", (F.col("is_left") == F.col("left_asks")).alias("asks"))
    dealt = checkpointed(dealt.repartitionByRange(max(1, -(-total // stretch)), "s", "v").withColumn("g", F.spark_partition_id()))
    end = f"struct<v:double,id:{kind}>"

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _matched(a, b)
        found.insert(0, "g", key[1])
        found.insert(0, "s", key[0])
        return found

    while True:
        pool = F.when(~F.col("asks"), F.struct("v", "id"))
        groups = dealt.groupBy("s", "g").agg(F.min(pool).cast(end).alias("least"), F.max(pool).cast(end).alias("most"))
        w = Window.partitionBy("s").orderBy("g")  # one row per stretch
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        bounds = groups.select("s", "g", F.last("most", ignorenulls=True).over(before).alias("lo"), F.first("least", ignorenulls=True).over(after).alias("hi"))
        found = dealt.groupBy("s", "g").cogroup(bounds.groupBy("s", "g")).applyInPandas(solve, f"s {dict(left.dtypes)[stratum]}, g int, ask {kind}, mate {kind}, ask_v double, mate_v double, crosses int")
        found = checkpointed(found)
        reach = found.where("crosses <> 0").groupBy("s", "g").agg(F.max(F.col("crosses") == 1).alias("up"), F.max(F.col("crosses") == -1).alias("down"))
        if reach.isEmpty():
            break
        joined = groups.select("s", "g").join(reach, ["s", "g"], "left").fillna(False, ["up", "down"])
        with_last = joined.withColumn("opens", ~(F.col("down") | F.coalesce(F.lag("up").over(w), F.lit(False))))
        new = with_last.select("s", "g", F.coalesce(F.last(F.when(F.col("opens"), F.col("g")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("g")).alias("to"))
        dealt = checkpointed(dealt.join(new, ["s", "g"]).select("s", "id", "v", "is_left", "asks", F.col("to").alias("g")))
    return found, sizes, dealt


def greedy_picks(df: DataFrame, category: str, key: list[str], order: list) -> DataFrame:
    """(category, key...): each category in turn (by its own order) takes the first of its rows, by `order`, whose key no
    category before it has taken; one without such a row takes none. With c categories no more than c keys of each can
    matter, so c * c rows meet in one fold; null categories and keys take no part."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [category, *key]))
    c = rows.select(category).distinct().count()
    w = Window.partitionBy(category)
    first = rows.withColumn("_n", F.row_number().over(w.orderBy(*order, *key))).groupBy(category, *key).agg(F.min("_n").alias("_n"))
    few = first.withColumn("_r", F.row_number().over(w.orderBy("_n"))).where(F.col("_r") <= c)
    lists = few.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*key).alias("k")))).alias("offers"))
    held = lists.agg(F.array_sort(F.collect_list(F.struct(F.col(category).alias("c"), "offers"))).alias("all"))
    kinds = dict(df.dtypes)
    k_type = "struct<" + ",".join(f"{x}:{kinds[x]}" for x in key) + ">"
    start = F.expr(f"cast(array() as array<struct<c:{kinds[category]},k:{k_type}>>)")

    def turn(state, x):
        taken = F.transform(state, lambda t: t["k"])
        free = F.filter(F.transform(x["offers"], lambda o: o["k"]), lambda k: ~F.array_contains(taken, k))
        return F.when(F.size(free) > 0, F.concat(state, F.array(F.struct(x["c"].alias("c"), F.get(free, 0).alias("k"))))).otherwise(state)

    return held.select(F.explode(F.aggregate("all", start, turn)).alias("p")).select(F.col("p.c").alias(category), "p.k.*")


def numbered(df: DataFrame, blocks: list, order: list, name: str) -> DataFrame:
    """`df` with a number from 1 over all rows by (blocks, order), without a task that sees all rows: rows are numbered
    inside blocks (columns whose order is that of the rows), and each block starts after the rows of those before it. Only
    one count per block is summed up in one task."""
    keys = [f"_block{i}" for i in range(len(blocks))]
    b = df.select("*", *((F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(blocks, keys, strict=True)))
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return b.withColumn("_inside", inside).join(counts.select(*keys, before.alias("_before")), keys).withColumn(name, F.col("_before") + F.col("_inside")).drop(*keys, "_inside", "_before")


def within_caliper(a: Column, b: Column, most: float = 1.0) -> Column:
    return F.abs(F.log2(1 + a) - F.log2(1 + b)) <= most


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, by: list[str], order: list, target: int) -> DataFrame:
    """`target` rows, one from each stratum in turn (strata in order of `by`)."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return turn.orderBy("turn", *by).limit(target)


def nearest_subset(counts: dict[str, int], target: float, least: int, most: int) -> list[str]:
    """The names, `least` to `most` of them, whose total is nearest to `target`; ties by fewer names, then by the names. Exact
    over all subsets, on the driver: at most 24 keys."""
    names = sorted(counts)
    n = len(names)
    if n > 24:
        raise ValueError(f"{n} keys, at most 24 can be searched")
    total, held = np.zeros(1 << n, np.int64), np.zeros(1 << n, np.int8)
    for i, c in enumerate(names):
        total[1 << i : 2 << i] = total[: 1 << i] + counts[c]
        held[1 << i : 2 << i] = held[: 1 << i] + 1
    allowed = np.flatnonzero((held >= least) & (held <= most))
    if not len(allowed):
        return []
    off = np.round(np.abs(total[allowed] - target), 3)
    best = allowed[off == off.min()]
    best = best[held[best] == held[best].min()]
    return min([names[i] for i in range(n) if m >> i & 1] for m in best.tolist())


def choose_split(counts: dict[str, int], target: float = 0.15) -> dict[str, str]:
    """Chromosome to partition: two disjoint subsets whose totals are jointly nearest to `target` of all, the rest is
    train; ties by fewer chromosomes, then by name. Exact over all subsets, on the driver: at most 24 keys."""
    names = sorted(counts)
    n, size = len(names), 1 << len(names)
    if n > 24:
        raise ValueError(f"{n} keys, at most 24 can be searched")
    if n < 2:
        return dict.fromkeys(names, "train")
    mask = np.arange(size)  # the first name is the highest bit
    total, held = np.zeros(size, np.int64), np.zeros(size, np.int8)
    for i, c in enumerate(reversed(names)):
        total[1 << i : 2 << i] = total[: 1 << i] + counts[c]
        held[1 << i : 2 << i] = held[: 1 << i] + 1
    error = np.abs(total - target * sum(counts.values()))
    by_name = held + (size - (mask & -mask) - mask)  # a subset's place among the tuples of its names
    order = np.lexsort((by_name, held, error))
    order = order[order != 0]
    best = np.full(size, size, np.int32)  # the place in `order` of the best subset of each set of names
    best[order] = np.arange(size - 1, dtype=np.int32)
    for i in range(n):
        b = best.reshape(-1, 2, 1 << i)
        np.minimum(b[:, 1], b[:, 0], out=b[:, 1])
    a = mask[1 : size - 1]  # all but none and all, so that something is left for the other
    b = order[best[size - 1 - a]]
    joint = error[a] + error[b]
    at = np.flatnonzero(joint == joint.min())
    a, b = min(zip(a[at].tolist(), b[at].tolist(), strict=True), key=lambda s: (held[s[0]] + held[s[1]], by_name[s[0]], by_name[s[1]]))
    return {c: "validation" if a >> n - 1 - i & 1 else "test" if b >> n - 1 - i & 1 else "train" for i, c in enumerate(names)}


def balanced_subsets(pairs: DataFrame, key: str, measures: list[tuple[Column, Column]], scope: list[str], target: float, least: int, wanted: int = 1,
                     most: int = 6, floor: int = 200, share: float | None = None, limit: float = 0.1, block: int = 64) -> list[tuple[str, ...]]:
    """The first `wanted` subsets of `scope`, by distance of their number of pairs from `target`, then size, then names, on
    which both sides of every measure are alike: a Kolmogorov-Smirnov distance of at most `limit`, on the subset and on
    the rest of the scope. A subset has `least` to `most` names and `floor` pairs or more, and no name has over `share` of them.

    Subsets (at most 24 names) are listed on the driver. Their distances come from counts per name and value, for
    `block` subsets at a time, so jobs end with the first block that holds enough; pairs never leave Spark. Raises
    ValueError if too few subsets will do.
    """
    if len(scope) > 24:
        raise ValueError(f"{len(scope)} keys, at most 24 can be searched")
    side = lambda m, c, p: F.struct(F.lit(m).alias("m"), c.cast("double").alias("v"), F.lit(p).alias("p"), F.lit(1.0 - p).alias("q"))
    sides = F.array(*(side(m, c, p) for m, both in enumerate(measures) for c, p in zip(both, (1.0, 0.0), strict=True)))
    tall = pairs.where(F.col(key).isin(scope)).select(F.col(key).alias("k"), F.explode(sides).alias("x")).select("k", "x.*")
    tall = tall.groupBy("k", "m", "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).persist()
    try:
        counts = dict(tall.where("m = 0").groupBy("k").agg(F.sum("p").cast("long")).collect())  # a row per name of the scope
        total = lambda s: sum(counts.get(c, 0) for c in s)
        every = (s for n in range(least, min(most, len(scope)) + 1) for s in itertools.combinations(scope, n))
        fit = [s for s in every if total(s) >= floor and (share is None or max(counts.get(c, 0) for c in s) <= share * total(s))]
        fit.sort(key=lambda s: (abs(total(s) - target), len(s), s))
        found: list[tuple[str, ...]] = []
        for at in range(0, len(fit), block):
            member = [(i, c in s, c) for i, s in enumerate(fit[at : at + block]) for c in scope]
            of = F.broadcast(pairs.sparkSession.createDataFrame(member, "i int, inside boolean, k string"))  # block x 24 rows at most
            by = ["i", "inside", "m"]
            c = cumulated(tall.join(of, "k").groupBy(*by, "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), by, "v")
            far = c.groupBy(*by).agg(F.max(F.abs(F.try_divide("tp", "pos") - F.try_divide("fp", "neg"))).alias("d"))
            good = far.groupBy("i").agg(F.count_if(F.col("d") <= limit).alias("n")).where(F.col("n") == 2 * len(measures))
            found += [fit[at + r["i"]] for r in good.orderBy("i").collect()]  # at most a block
            if len(found) >= wanted:
                return found[:wanted]
    finally:
        tall.unpersist()
    raise ValueError(f"{len(found)} of {wanted} subsets satisfy the counts and the balance")


def fixed_test_and_folds(pairs: DataFrame, key: str, measures: list[tuple[Column, Column]], names: list[str], share: float = 0.15, limit: float = 0.1, folds: int = 3, floor: int = 200) -> DataFrame:
    """(part, name): a balanced test set of three names or more, none with over half of it, and for every fold another
    balanced validation set of the other names. Sets aim at `share` of all pairs; what a fold leaves is its train set."""
    n = pairs.where(F.col(key).isin(names)).count()
    ask = {"target": n * share, "limit": limit, "floor": floor}
    (test,) = balanced_subsets(pairs, key, measures, names, least=3, share=0.5, **ask)
    rest = [c for c in names if c not in test]
    parts = {"test": test} | {f"validation {i + 1}": s for i, s in enumerate(balanced_subsets(pairs, key, measures, rest, least=1, wanted=folds, **ask))}
    return pairs.sparkSession.createDataFrame([(part, c) for part, s in parts.items() for c in s], "part string, name string")
