"""Nearest matching in stretches against the plain greedy loop over a whole stratum."""

import random

import pytest

from spanweave.operators import matching as M


def plain(left, right):
    """[(left id, right id)] of one stratum."""
    swap = len(left) > len(right)
    ask, free = (right, sorted((v, i) for i, v in left)) if swap else (left, sorted((v, i) for i, v in right))
    out = []
    for v, i in sorted((v, i) for i, v in ask):
        if not free:
            break
        below = [x for x in free if x[0] < v]
        options = below[-1:] + free[len(below) : len(below) + 1]
        best = min(options, key=lambda x: (abs(x[0] - v), x[1]))
        free.remove(best)
        out.append((best[1], i) if swap else (i, best[1]))
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "m", "values"), [(1, 60, 200, 50), (2, 150, 160, 1000), (3, 100, 90, 7), (4, 1, 40, 3), (5, 120, 500, 10_000)])
def test_stretches_equal_the_whole_stratum(spark, seed, n, m, values):
    rng = random.Random(seed)
    strata = ["x", "y"]
    sides = [[(s, i, float(rng.randrange(values))) for i, s in enumerate(rng.choices(strata, k=k))] for k in (n, m)]
    frames = [spark.createDataFrame([*r, (None, 10**6, 1.0), ("x", 10**6 + 1, None)], "s string, id long, v double") for r in sides]
    got = M.nearest_match(*frames, "s", "v", stretch=16).collect()
    want = sorted(p for s in strata for p in plain(*([(i, v) for t, i, v in r if t == s] for r in sides)))
    assert sorted((r["left_id"], r["right_id"]) for r in got) == want
    value = [{i: v for _, i, v in r} for r in sides]
    assert all((r["left_value"], r["right_value"]) == (value[0][r["left_id"]], value[1][r["right_id"]]) for r in got)


def test_no_group_holds_a_stratum(spark):
    """One stratum of 4500 rows: what is matched together stays a small part of it."""
    frames = [spark.range(k).selectExpr("'one' as s", "id", f"double(id * {4000 // k} + pmod(hash(id), 3)) as v") for k in (500, 4000)]
    found, _, dealt = M.in_stretches(*frames, "s", "v", "id", 200)
    assert found.count() == 500 and dealt.groupBy("s", "g").count().agg({"count": "max"}).first()[0] < 1500


def test_empty_sides(spark):
    a = spark.createDataFrame([("x", 1, 2.0)], "s string, id long, v double")
    assert M.nearest_match(a, a.limit(0), "s", "v").collect() == []


def test_greedy_picks(spark):
    rows = [("a", 1, 5), ("a", 2, 4), ("b", 2, 1), ("b", 1, 2), ("c", 2, 0), ("c", 1, 1), ("d", 1, 0), ("d", 3, 9), ("d", 3, 1), (None, 4, 0), ("e", None, 0)]
    d = spark.createDataFrame(rows, "cat string, key int, v int")
    got = M.greedy_picks(d, "cat", ["key"], ["v"]).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1), ("d", 3)]  # c finds both taken
    assert M.greedy_picks(d.limit(0), "cat", ["key"], ["v"]).collect() == []
