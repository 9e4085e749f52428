"""The network scorer, mutagenesis, sketches and masks against plain Python, tiling of long texts, bootstraps in blocks."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import resample, scorer, sketches, stats
from spanweave.plans import fixtures, scoring


def letters(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def plain_logit(net, s):
    """Convolutions with zeros beyond both ends, letter by letter."""
    x = [[1.0 if b == c else 0.0 for c in "ACGT"] for b in s]
    for k, bias in zip(net.kernels, net.biases, strict=True):
        width, left = k.shape[1], (k.shape[1] - 1) // 2
        x = [
            [max(0.0, bias[f] + sum(k[f, j, c] * x[i + j - left][c] for j in range(width) if 0 <= i + j - left < len(x) for c in range(k.shape[2]))) for f in range(k.shape[0])]
            for i in range(len(x))
        ]
    pooled = [sum(v) / len(v) if net.pool == "mean" else max(v) for v in zip(*x, strict=True)]
    return net.head_bias + sum(a * b for a, b in zip(net.head, pooled, strict=True))


def network(rng, layers, pool, width=4):
    sizes = [4, *layers]
    return scorer.ConvNet([rng.normal(size=(o, width, i)) for i, o in itertools.pairwise(sizes)], [rng.normal(size=o) for o in layers], rng.normal(size=layers[-1]), 0.25, pool)


@pytest.mark.parametrize(("layers", "pool"), [((3,), "max"), ((3,), "mean"), ((3, 2), "max"), ((2, 3), "mean")])
def test_scores_and_mutants_equal_plain_python(spark, layers, pool):
    net, rng = network(np.random.default_rng(1), layers, pool), random.Random(2)
    texts = [letters(rng, n) for n in (1, 2, 5, 12, 12, 17)] + ["ACGNNT", "acgt", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    held = {i: t.upper() for i, t in enumerate(texts) if t}
    got = {r["id"]: r for r in scorer.score_sequences(d, "i", "s", net).collect()}
    assert set(got) == set(held)
    for i, t in held.items():
        assert got[i]["logit"] == pytest.approx(plain_logit(net, t), abs=1e-9)
        assert got[i]["probability"] == pytest.approx(1 / (1 + math.exp(-got[i]["logit"])), abs=1e-12)
    for difference in ("logit", "probability"):
        value = (lambda t: plain_logit(net, t)) if difference == "logit" else (lambda t: 1 / (1 + math.exp(-plain_logit(net, t))))
        for r in scorer.mutagenesis(d, "i", "s", net, difference).collect():
            t = held[r["id"]]
            for p in range(len(t)):
                want = [0.0 if t[p] == b else value(t) - value(t[:p] + b + t[p + 1 :]) for b in "ACGT"]
                assert r["effects"][p] == pytest.approx(want, abs=1e-9)
                others = 3 if t[p] in "ACGT" else 4
                assert r["signed"][p] == pytest.approx(sum(want) / others, abs=1e-9) and r["magnitude"][p] == pytest.approx(sum(map(abs, want)) / others, abs=1e-9)


def test_every_position_has_an_effect():
    codes = np.random.default_rng(3).integers(0, 4, (4, 256))
    effects = scoring.NET.logits(codes)[:, None, None] - scoring.NET.mutant_logits(codes)
    assert (np.abs(effects).max(2) > 1e-6).all()


def test_network_layers_must_fit():
    with pytest.raises(ValueError, match="fit"):
        scorer.ConvNet([np.zeros((2, 3, 4)), np.zeros((2, 3, 5))], [np.zeros(2), np.zeros(2)], np.zeros(2))


def test_tiles_of_any_length(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ABC", k=n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 40)]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in d.select(fixtures.tiles(F.col("s"), 8)).collect()]
    assert got == [[t[min(i, len(t) - 8) :][:8] for i in range(0, len(t), 8)] if len(t) >= 8 else [] for t in texts]


def test_long_texts_tile_in_linear_time(spark):
    d = spark.range(1).select(F.expr("repeat('ACGTTGCA', 500000)").alias("s"))  # 4 MB
    began = time.time()
    assert d.select(F.explode(fixtures.tiles(F.col("s"), 256))).count() == 15625
    assert time.time() - began < 5


# --- sketches --------------------------------------------------------------------------------------------------------

_WRAP = (1 << 64) - 1


def plain_sketch(s, k, size, seed):
    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) & _WRAP
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WRAP
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WRAP
        return x ^ (x >> 31)

    out = set()
    for i in range(len(s) - k + 1):
        w = s[i : i + k]
        if set(w) <= set("ACGT"):
            codes = [int("".join(str("ACGT".index(b)) for b in t), 4) for t in (w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))]
            out.add(mixed(min(codes) ^ seed))
    return sorted(out)[:size]


@pytest.mark.parametrize(("k", "size", "seed"), [(15, 128, 0), (12, 96, 99), (31, 8, 2**63 + 5), (1, 3, 1)])
def test_sketches_equal_plain_python(spark, k, size, seed):
    rng = random.Random(k)
    texts = [letters(rng, n) for n in (256, 256, 40, 12, 3)] + ["ACGTN" * 30, "n" * 50, "acgt" * 40]
    d = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "i long, s string")
    got = {r["id"]: [h & _WRAP for h in r["hashes"]] for r in sketches.seeded_sketches(d, "i", "s", k, size, seed).collect()}
    assert got == {i: plain_sketch(t.upper(), k, size, seed) for i, t in enumerate(texts)}


def edited(rng, s, edits):
    for _ in range(edits):
        p = rng.randrange(len(s))
        s = rng.choice([s[:p] + rng.choice("ACGT") + s[p + 1 :], s[:p] + s[p + 1 :], s[:p] + rng.choice("ACGT") + s[p:]])
    return s


def test_masks_drop_no_planted_copy(spark):
    """Copies with up to 12 edits of 256, shifted and turned: kept by all three steps; unrelated pairs fall away."""
    rng = random.Random(6)
    turned = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(300):
        a = letters(rng, 256)
        b = edited(rng, a, rng.randrange(13))
        b = b[10:] + letters(rng, 10) if i % 3 == 0 else b
        rows.append((i, i, a, b[::-1].translate(turned) if i % 2 else b))
    rows += [(1000 + i, i, letters(rng, 256), letters(rng, 256)) for i in range(300)] + [(2000, 0, None, "ACGT"), (2001, 0, "", "")]
    got = {r["a"]: r for r in sketches.mask_cascade(spark.createDataFrame(rows, "a long, b long, sa string, sb string")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["passed"] == 3 for i in range(300)) >= 297
    assert sum(got[1000 + i]["passed"] == 3 for i in range(300)) <= 3
    first = got[0]["common"][0]
    grams = [{min(s[i : i + 6], s[i : i + 6][::-1].translate(turned)) for i in range(len(s) - 5)} for s in rows[0][2:]]
    assert first == len(grams[0] & grams[1]) and got[2001]["common"] == [0, None, None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_confirmed_alignments_equal_the_plain_search(spark):
    rng = random.Random(7)
    turned = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(12):
        a = letters(rng, 40)
        b = edited(rng, a, rng.randrange(6))
        b = b[::-1].translate(turned) if i % 3 == 0 else b
        rows.append((i, 50 + i, a, b))
    rows.append((90, 91, letters(rng, 40), letters(rng, 40)))
    want = {}
    for a, b, x, y in rows:
        longest = max(len(x), len(y))
        found = []
        for o, z in ((0, y), (1, y[::-1].translate(turned))):
            for t in range(-longest, longest + 1):
                left, right = x[max(t, 0) :], z[max(-t, 0) :]
                n = min(len(left), len(right))
                if n >= math.ceil(0.9 * longest - 1e-9):
                    identity = 1 - distance(left[:n], right[:n]) / n
                    if identity >= 0.9 - 1e-9:
                        found.append((-round(identity, 9), -round(n / longest, 9), o, t))
        if found:
            i, c, o, t = min(found)
            want[a] = (b, -i, -c, "reverse" if o else "forward", t)
    got = {r["a"]: (r["b"], r["identity"], r["coverage"], r["orientation"], r["shift"]) for r in sketches.confirmed_alignment(spark.createDataFrame(rows, "a long, b long, sa string, sb string")).collect()}
    assert got == want and 90 not in got


# --- resampling ------------------------------------------------------------------------------------------------------


def test_bootstraps_in_many_blocks(spark, monkeypatch):
    """A cell dealt into blocks: every draw of a cell takes as many rows as it has, and the spread is that of a mean."""
    monkeypatch.setattr(resample, "BLOCK", 64)
    v = spark.range(1000).selectExpr("'g' as g", "id as o", "double(id % 10) as x", "1.0D as one")
    ones = resample.replicate_means(v.select("g", "o", F.col("one").alias("x")), ["g"], [], 50)
    assert [r["x"] for r in ones.collect()] == pytest.approx([1.0] * 50)
    means = np.array([r["x"] for r in resample.replicate_means(v.select("g", "o", "x"), ["g"], [], 400).collect()])
    assert len(means) == 400 and abs(means.mean() - 4.5) < 0.02 and 0.075 < means.std() < 0.11  # 2.87 / sqrt(1000) = 0.091


@pytest.mark.parametrize("alternative", ["greater", "less"])
def test_signed_rank_tails_equal_enumeration(spark, alternative):
    rng = random.Random(8)
    groups = {g: [float(rng.choice([-3, -2, -1, 0, 1, 2, 3, 4])) if g % 2 else rng.uniform(-1, 2) for _ in range(g)] for g in range(1, 13)}
    groups[90] = [0.0, 0.0, 0.0]
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [(3, None), (3, float("nan")), (91, None)]
    got = {r["g"]: r for r in stats.signed_rank_test(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", alternative).collect()}
    for g, xs in groups.items():
        d = [x for x in xs if x]
        if len(xs) < 2 or not d:
            assert got[g]["p"] is None
            continue
        ranks = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
        w = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        met = [v >= w - 1e-9 if alternative == "greater" else v <= w + 1e-9 for v in sums]
        assert (got[g]["n"], got[g]["w_plus"]) == (len(d), pytest.approx(w)) and got[g]["p"] == pytest.approx(sum(met) / len(met))


def test_signed_rank_normal_tail_joins_the_exact_one(spark):
    rng = random.Random(9)
    xs = [round(rng.uniform(-1, 1.3), 3) for _ in range(50)]
    exact = stats.signed_rank_test(spark.createDataFrame([("a", x) for x in xs], "g string, x double"), ["g"], "x").first()["p"]
    w = stats.signed_rank_test(spark.createDataFrame([("a", x) for x in [*xs, 2.0]], "g string, x double"), ["g"], "x").first()
    z = (w["w_plus"] - 51 * 52 / 4) / math.sqrt(51 * 52 * 103 / 24)
    assert w["n"] == 51 and w["p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=0.02) and 0 < exact < 1
