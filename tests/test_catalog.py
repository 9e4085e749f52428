"""Every registered query of the library against its DuckDB twin, or at least its invariants."""

import math
import os

import duckdb
import pytest

from spanweave.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 8) + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_greedy_nonoverlap_is_maximal_and_disjoint(spark):
    from spanweave.operators.intervals import greedy_nonoverlap
    from spanweave.plans.fixtures import peaks

    p = peaks(spark, DIR, 200_000)
    rows = {r["id"]: r for r in p.collect()}
    kept = {r["id"] for r in greedy_nonoverlap(p, ["signal", "score"]).collect() if r["kept"]}
    chosen = []
    for r in sorted(rows.values(), key=lambda r: (-r["signal"], -r["score"], r["id"])):
        if not any(r["chrom"] == c["chrom"] and r["start_bp"] < c["end_bp"] and c["start_bp"] < r["end_bp"] for c in chosen):
            chosen.append(r)
    assert kept == {r["id"] for r in chosen}


def test_nearest_match_uses_each_row_once(spark):
    m = catalog.QUERIES["nearest_match"](spark, DIR).collect()
    assert m and len({r["left_id"] for r in m}) == len(m) == len({r["right_id"] for r in m})


def test_choose_split():
    from spanweave.operators.matching import choose_split

    parts = choose_split({"a": 15, "b": 15, "c": 40, "d": 30})
    assert sorted(k for k, v in parts.items() if v != "train") == ["a", "b"]


def test_choose_split_is_exact():
    import itertools
    import random

    from spanweave.operators.matching import choose_split

    alike = choose_split({"a": 10_000, **{f"b{i:02}": 951 for i in range(21)}})
    assert sorted(alike.values()).count("validation") == sorted(alike.values()).count("test") == 5
    r = random.Random(3)
    for _ in range(20):
        counts = {f"c{i}": r.randint(1, 12) for i in range(6)}
        want, subsets = 0.15 * sum(counts.values()), [s for k in range(1, 6) for s in itertools.combinations(sorted(counts), k)]
        off = {s: abs(sum(counts[c] for c in s) - want) for s in subsets}
        _, _, a, b = min((off[x] + off[y], len(x) + len(y), x, y) for x in subsets for y in subsets if not set(x) & set(y))
        assert choose_split(counts) == {c: "validation" if c in a else "test" if c in b else "train" for c in counts}


def test_nearest_match_asks_with_every_peak(spark):
    from spanweave.plans.fixtures import peaks

    sides = {r["chrom"]: (r["low"], r["n"] - r["low"]) for r in peaks(spark, DIR).groupBy("chrom").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(peaks(spark, DIR).where("score < 500").groupBy("chrom").count().withColumnRenamed("count", "low"), "chrom").collect()}
    assert catalog.QUERIES["nearest_match"](spark, DIR).count() == sum(min(s) for s in sides.values())


def test_best_alignment_finds_far_shifts(spark):
    import random

    from spanweave.operators.similarity import best_alignment

    r = random.Random(5)
    x = "".join(r.choice("ACGT") for _ in range(300))
    rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, 2, x[:256], x[40:296]), (3, 4, x[30:286], x[:256]), (5, 6, x[:256], rc(x[44:300])), (7, 8, x[:256], x[1:257])]
    got = {g.a: (g.shift, g.orientation, g.identity) for g in best_alignment(spark.createDataFrame(rows, "a long, b long, sa string, sb string")).collect()}
    assert got == {1: (40, "forward", 1.0), 3: (-30, "forward", 1.0), 5: (44, "reverse", 1.0), 7: (1, "forward", 1.0)}


def test_align_verify_uses_the_whole_sketch(spark):
    from spanweave.operators import similarity as X
    from spanweave.plans.fixtures import dna

    want = X.sketch_candidates(X.bottom_k(dna(spark, DIR), "doc_id", "seq", 12, 96), 500).select("a", "b")
    assert {tuple(r) for r in catalog.QUERIES["align_verify"](spark, DIR).select("a", "b").collect()} == {tuple(r) for r in want.collect()}
