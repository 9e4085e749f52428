"""Operators on small tables against plain Python, and inputs that must be refused."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanweave.functions import sequence as S
from spanweave.operators import arrays as A
from spanweave.operators import matching as M
from spanweave.operators import motifs as P
from spanweave.operators import resample as B
from spanweave.operators import similarity as X
from spanweave.sources import genomic as G
from spanweave.sources import sinks as K

PWM = A.pwm_weights({"A": [3.0, 10.0, 0.0, 18.0], "C": [5.0, 2.0, 0.0, 1.0], "G": [9.0, 4.0, 19.0, 0.0], "T": [3.0, 4.0, 1.0, 1.0]})


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_lengths_are_checked(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), (None, "A"), ("AC", None)], "a string, b string")
    assert [r[0] for r in df.select(S.hamming(F.col("a"), F.col("b"))).collect()] == [1, None, None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("ACGT", "AC")], "a string, b string").select(S.hamming(F.col("a"), F.col("b"))).collect()
    short = spark.createDataFrame([("AC",), ("ACG",), ("ACGT",), ("",)], "s string").select(S.kmers(F.col("s"), 3)).collect()
    assert [r[0] for r in short] == [[], ["ACG"], ["ACG", "CGT"], []]


def test_windows_are_checked(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one a > b\nacgt\nACGT\n>two\nAC\n")
    chunks = G.chunked(G.read_fasta(spark, str(path)), 3)
    assert {(r.chrom, r.chunk, r.seq) for r in chunks.collect()} == {("one", 0, "ACG"), ("one", 1, "TAC"), ("one", 2, "GT"), ("two", 0, "AC")}
    get = lambda *w: {r.id: r.seq for r in G.fetch_windows(spark.createDataFrame(list(w), "id int, chrom string, start_bp long, end_bp long"), chunks, 3).collect()}
    assert get((1, "one", 1, 8), (2, "two", 0, 2), (3, "one", 2, 3)) == {1: "CGTACGT", 2: "AC", 3: "G"}
    for bad in ((1, "one", -1, 3), (1, "one", 5, 9), (1, "one", 20, 22), (1, "three", 0, 1), (1, "one", 3, 3)):
        with pytest.raises(PySparkException):
            get(bad)


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_text("# head\n" + "".join(f"chr1\t{i}\t{i + 1}\tn\t{i}\t.\t1.5\t0\t0\t0\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        p = G.read_narrowpeak(spark, str(path), "acc")
        assert p.rdd.getNumPartitions() > 1
        assert all(r.row_number == r.start_bp + 2 for r in p.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_runs_and_digests(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "m.csv").write_text("id,fold1,fold2\n1,train,test\n2,test,test\n")
    schema = "id int, fold1 string, fold2 string"
    assert sorted((r.id, r.run) for r in G.read_runs(spark, f"{tmp_path}/*/m.csv", schema).collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert [r.id for r in G.read_folds(spark, f"{tmp_path}/a/m.csv", schema, ["fold1", "fold2"]).collect()] == [1]
    with pytest.raises(Exception, match="m.csv"):
        G.read_table(spark, f"{tmp_path}/a/m.csv", "id int, other string, fold2 string").collect()
    seen = K.file_digests(spark, f"{tmp_path}/a/m.csv")
    want = spark.createDataFrame([("m.csv", seen.first().sha256), ("gone.csv", "0")], "name string, sha256 string")
    assert {r.name: r.passed for r in K.verified(seen, want).collect()} == {"m.csv": True, "gone.csv": False}
    K.write_arrays(spark.createDataFrame([(1, [1.0, 2.0])], "id int, a array<double>"), f"{tmp_path}/arrays")
    assert G.read_arrays(spark, f"{tmp_path}/arrays", ["a"]).first().a == [1.0, 2.0]


def test_content_hash_counts_repeated_rows(spark):
    h = lambda rows: K.content_hash(spark.createDataFrame(rows, "a int")).first()
    assert h([(1,), (2,)]) == h([(2,), (1,)]) and h([(1,), (1,), (2,)]).hash != h([(3,), (3,), (2,)]).hash and h([(1,)]).rows == 1


def test_pwm_hits(spark):
    seqs = ["ACG", "", None, "ACGT", "NNNNN", "ACGNGATAC", *(dna(40, i) for i in range(30))]
    got = {r.id: r for r in A.pwm_best_hits(spark.createDataFrame(list(enumerate(seqs)), "i int, s string"), "i", "s", PWM).collect()}
    want = {}
    for i, s in enumerate(seqs):
        for start in range(len(s or "") - 3):
            k = s[start : start + 4]
            if set(k) <= set("ACGT"):
                for strand, x in (("+", k), ("-", rc(k))):
                    key = (-round(sum(c[b] for c, b in zip(PWM, x, strict=True)), 9), start, strand)
                    want[i] = min(want.get(i, key), key)
    assert {i: (-r.score, r.start, r.strand) for i, r in got.items()} == want and all(0 <= r.relative <= 1 for r in got.values())


def test_disruption_takes_score_from_the_hit(spark):
    df = spark.createDataFrame([(i, dna(30, i)) for i in range(20)], "id int, s string")
    for r in P.disrupt(df.join(A.pwm_best_hits(df, "id", "s", PWM), "id"), "s", PWM).collect():
        assert [i for i in range(30) if r.s[i] != r.mutant[i]] == r.changed == list(range(r.start, r.start + 4))
        k = r.mutant[r.start : r.start + 4]
        assert sum(c[b] for c, b in zip(PWM, k if r.strand == "+" else rc(k), strict=True)) < r.score


def test_near_motifs_of_several_lengths(spark):
    motifs, seqs = ["GATAAG", "CCGC", "TTTT"], ["GATAAG", "AC", "", *(dna(60, 100 + i) for i in range(8))]
    got = {(r.id, r.start, r.end, r.motif, r.orientation, r.distance) for r in P.near_motif_scan(spark.createDataFrame(list(enumerate(seqs)), "i int, s string"), "i", "s", motifs, 1).collect()}
    best = {}
    for i, s in enumerate(seqs):
        for m, motif in enumerate(motifs):
            for start in range(len(s) - len(motif) + 1):
                k = s[start : start + len(motif)]
                for o, x in ((0, k), (1, rc(k))):
                    d = sum(a != b for a, b in zip(x, motif, strict=True))
                    if d <= 1:
                        key = (i, start, start + len(motif))
                        best[key] = min(best.get(key, (9, 0, 0)), (d, m, o))
    assert got == {(*k, m, o, d) for k, (d, m, o) in best.items()}


def mutated(s, r, share):
    return "".join(r.choice("ACGT".replace(c, "")) if r.random() < share else c for c in s)


def test_planted_copies_are_found_by_the_filter_chain(spark):
    for share, least in ((0.05, 0.97), (0.1, 0.9)):
        r = random.Random(5)
        seqs = [dna(256, i) for i in range(60)]
        rows = list(enumerate(seqs)) + [(100 + i, mutated(s if i % 2 else rc(s), r, share)) for i, s in enumerate(seqs)]
        df = spark.createDataFrame(rows, "id int, s string")
        pairs = X.sketch_candidates(X.bottom_k(df, "id", "s", 12, 96), 500).select("a", "b")
        for c in "ab":
            pairs = pairs.join(df.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")), c)
        best = X.best_alignment(pairs).where(X.edge_class(F.col("identity"), F.col("coverage")).isNotNull()).collect()
        found = {(x.a, x.b) for x in best}
        assert len(found & {(i, 100 + i) for i in range(60)}) >= least * 60 and not found - {(i, 100 + i) for i in range(60)}


def test_seeds_are_the_common_kmers():
    r = random.Random(6)
    for _ in range(20):
        a, b = dna(r.randint(0, 40), r.random()), dna(r.randint(0, 40), r.random())
        b = b + a[3:20]
        want = {}
        for i, j in itertools.product(range(len(a) - 4), range(len(b) - 4)):
            if a[i : i + 5] == b[j : j + 5] and abs(i - j) <= 15:
                want[i - j] = want.get(i - j, 0) + 1
        assert dict(X.seeds_of(a, b, 5, 15)) == want


def test_numbers_follow_the_order(spark):
    r = random.Random(7)
    rows = [(r.randint(0, 5), r.randint(0, 100), i) for i in range(300)]
    got = M.numbered(spark.createDataFrame(rows, "c int, x int, id int"), ["c", F.floor(F.col("x") / 10)], ["x", "id"], "n").collect()
    assert [x.id for x in sorted(got, key=lambda x: x.n)] == [i for _, _, i in sorted(rows)] and {x.n for x in got} == set(range(1, 301))


def test_nearest_subset():
    r = random.Random(8)
    for _ in range(20):
        counts = {f"c{i}": r.randint(1, 50) for i in range(7)}
        sets = [c for n in range(2, 5) for c in itertools.combinations(sorted(counts), n)]
        assert tuple(M.nearest_subset(counts, 60, 2, 4)) == min(sets, key=lambda c: (abs(sum(counts[x] for x in c) - 60), len(c), c))


def test_bootstrap_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("b", 1, 1, None), ("c", 1, 1, float("nan")), ("c", 1, 2, 3.0), ("c", 2, 5, 5.0)], "g string, level int, i int, x double")
    got = {r.g: r for r in B.hierarchical_bootstrap(df, ["g"], ["level"], "i", "x", 50).collect()}
    assert set(got) == {"a", "c"} and (got["a"].n, got["a"].estimate, got["a"].low, got["a"].high) == (1, 2.0, 2.0, 2.0)
    assert got["c"].n == 2 and got["c"].estimate == 4.0 and 3.0 <= got["c"].low <= got["c"].high <= 5.0 and got["a"].p == 0.0 and abs(got["a"].p_corrected - 2 / 51) < 1e-12


def test_kmer_spectrum(spark):
    seqs = ["", None, "AC", "ACGTNACG", "acgt", *(dna(30, i) for i in range(9))]
    want = {}
    for s in seqs:
        t = (s or "").upper()
        for x in {min(t[i : i + 3], rc(t[i : i + 3])) for i in range(len(t) - 2) if set(t[i : i + 3]) <= set("ACGT")}:
            want[x] = want.get(x, 0) + 1
    assert {r.kmer: r.docs for r in X.kmer_spectrum(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", 3).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_islands_over_stretches(spark, seed, monkeypatch):
    import random

    from spanweave.operators import intervals as I

    monkeypatch.setattr(I, "STRETCH", 16)
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), s, s + r.choice([0, 1, 5, 17, 90])) for s in (r.randrange(1500) for _ in range(120))] + [("a", None, 4), ("a", 3, None)]
    df = spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long")
    for touching in (True, False):
        want = []
        for c, s, e in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (str(x[0]), x[1], x[2])):
            if want and want[-1][0] == c and (s <= want[-1][2] if touching else s < want[-1][2]):
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, s, e])
        g = I.islands(df, touching=touching).groupBy("chrom", F.col("island").alias("start_bp")).agg(F.max("end_bp").alias("end_bp"))
        # an empty interval alone, at the start of the next, is one island with it by its start
        tidy = {}
        for c, s, e in want:
            tidy[c, s] = max(e, tidy.get((c, s), e))
        assert sorted(map(tuple, g.collect()), key=str) == sorted(((c, s, e) for (c, s), e in tidy.items()), key=str)
        if touching:
            assert sorted(map(tuple, I.merge(df).collect()), key=str) == sorted(((c, s, e) for (c, s), e in tidy.items()), key=str)
    assert I.merge(df.limit(0)).count() == 0


def test_order_within_groups(spark):
    import random

    from spanweave.operators import ordered as O

    r = random.Random(5)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), None, 1.0, 0.9999999999999999, 2.0, 1.9999999999999998]
    rows = [(r.choice(["x", None]), r.choice(odd) if r.random() < 0.5 else r.uniform(-3, 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")

    def key(v):
        return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v + 0.0)

    want = sorted((str(g), key(v), sum(key(w) < key(v) for h, w in rows if h == g) + (sum(key(w) == key(v) for h, w in rows if h == g) + 1) / 2) for g, v in rows)
    got = sorted((str(x["g"]), key(x["v"]), x["r"]) for x in O.average_ranks(df, ["g"], "v", "r").collect())
    assert got == want
    t = df.groupBy("g", "v").agg(F.min(F.hash("g", "v")).alias("m"))
    low = O.least_from(t, ["g"], "v", "m").collect()
    assert all(x["m_least"] == min(y["m"] for y in low if y["g"] == x["g"] and key(y["v"]) >= key(x["v"])) for x in low)


def test_false_discovery_by_hand(spark):
    from spanweave.operators.stats import benjamini_hochberg

    p = [0.01, 0.04, 0.03, 0.03, None, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = {x["i"]: x["q"] for x in benjamini_hochberg(df, [], "p").collect()}
    assert q.pop(4) is None
    assert {i: round(v, 9) for i, v in q.items()} == {0: 0.05, 1: 0.05, 2: 0.05, 3: 0.05, 5: 0.9}
    assert benjamini_hochberg(df, [], "p", missing_as_one=True).where("i = 4").first()["q"] == 1.0


def test_roc_band_of_two_repeats(spark):
    import numpy as np

    from spanweave.operators.stats import roc_band

    r = np.random.default_rng(2)
    rows = [(k, int(y), float(round(x, 1))) for k in range(2) for y, x in zip(r.integers(0, 2, 60), r.random(60), strict=True)]
    got = sorted(roc_band(spark.createDataFrame(rows, "k int, y int, x double"), [], "k", "y", "x", 20).collect())
    curves = []
    for k in range(2):
        y, x = (np.array([row[i] for row in rows if row[0] == k]) for i in (1, 2))
        cuts = sorted(set(x), reverse=True)
        fpr, tpr = ([0.0] + [float((x[y == c] >= t).mean()) for t in cuts] for c in (0, 1))
        c = np.interp(np.linspace(0, 1, 21), fpr, tpr)
        c[0], c[-1] = 0, 1
        curves.append(c)
    mean, sd = np.mean(curves, axis=0), np.std(curves, axis=0, ddof=1)
    assert [x["point"] for x in got] == list(range(21))
    assert np.allclose([x["mean"] for x in got], mean) and np.allclose([x["low"] for x in got], np.clip(mean - sd, 0, 1)) and np.allclose([x["high"] for x in got], np.clip(mean + sd, 0, 1))


def test_planted_motifs_do_not_repeat(spark):
    from spanweave.sources.synthetic import planted_motifs

    rows = planted_motifs(spark, {"train": 120, "test": 41}, "GA", 6, 3).collect()  # so short that draws repeat
    keys = {min(x["sequence"], rc(x["sequence"])) for x in rows}
    assert len(keys) == len(rows) == 161 and any(x["redraw"] for x in rows)
    assert sum(x["label"] for x in rows if x["split"] == "train") == 60 and sum(x["label"] for x in rows if x["split"] == "test") == 20
    for x in rows:
        if x["label"]:
            assert x["sequence"][x["motif_start"] : x["motif_end"]] == ("GA" if x["motif_orientation"] == "forward" else "TC")
        else:
            assert "GA" not in x["sequence"] and "TC" not in x["sequence"] and x["motif_start"] is None
    with pytest.raises(ValueError, match="too few"):
        planted_motifs(spark, {"train": 40}, "GAC", 3, 3)
    assert planted_motifs(spark, {"train": 0}, "GA", 6, 3).count() == 0


def test_balanced_subsets_are_the_first_that_fit(spark):
    r = random.Random(9)
    rows = [(c, r.random() + (0.3 if c == "c2" else 0.0), r.random(), r.choice([1, 2, 3]), r.choice([1, 2, 3])) for c in ("c1", "c2", "c3", "c4", "c5") for _ in range(40 + 7 * int(c[1]))]
    df = spark.createDataFrame(rows, "c string, a double, b double, x int, y int")

    def ks(p, q):
        return max(abs(sum(v <= t for v in p) / len(p) - sum(v <= t for v in q) / len(q)) for t in p + q)

    def alike(names):
        m = [x for x in rows if x[0] in names]
        return m and all(ks([x[i] for x in m], [x[j] for x in m]) <= 0.2 for i, j in ((1, 2), (3, 4)))

    names = ["c1", "c2", "c3", "c4", "c5"]
    size = lambda s: sum(x[0] in s for x in rows)
    fit = [s for n in range(1, 5) for s in itertools.combinations(names, n) if size(s) >= 90 and max(size([c]) for c in s) <= 0.8 * size(s)]
    fit.sort(key=lambda s: (abs(size(s) - 120), len(s), s))
    want = [s for s in fit if alike(s) and alike([c for c in names if c not in s])][:2]
    ask = {"target": 120, "least": 1, "most": 4, "floor": 90, "share": 0.8, "limit": 0.2, "block": 3}
    assert M.balanced_subsets(df, "c", [(F.col("a"), F.col("b")), (F.col("x"), F.col("y"))], names, wanted=len(want), **ask) == want and want
    with pytest.raises(ValueError, match="subsets satisfy"):
        M.balanced_subsets(df, "c", [(F.col("a"), F.col("b") + 9)], names, **ask)


def test_distribution_distance_and_its_p(spark):
    from spanweave.operators.stats import kolmogorov_smirnov

    rows = [(1, float(i)) for i in range(50)] + [(0, float(i + 10)) for i in range(50)]
    x = kolmogorov_smirnov(spark.createDataFrame(rows, "y int, v double"), "y", "v").first()
    assert abs(x["ks"] - 0.2) < 1e-9 and abs(x["p"] - 0.2699996717) < 1e-6  # Kolmogorov's Q(1)
    one = kolmogorov_smirnov(spark.createDataFrame([(1, 0.5)], "y int, v double"), "y", "v").first()
    assert one["ks"] is None and one["p"] is None
