"""Centroid clustering, collocations and substring removal against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from spanweave.llm import clusters, counting, phrases, substrings

# --- centroid clustering ---------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, seed=3, scale=1024):
    """Plain k-means in Python's integers: [(id, cluster, distance)], centroids."""
    v = [(i, [int(np.floor(Fraction(x) * scale)) for x in e]) for i, e in rows]
    start = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(r[1]) for r in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))[1]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in v:
            groups[near(x)].append(x)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if groups[j] else c[j] for j in range(len(c))]
    return [(i, near(x), far(x, c[near(x)])) for i, x in v], c


def clustered(spark, rows, **options):
    d = spark.createDataFrame([(i, e, "x", "y", 1, "z") for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance string, v int, id string")
    return clusters.cluster_vectors(d, **options).collect()


def equal_to_plain(spark, rows, k, rounds, dims):
    got = clustered(spark, rows, k=k, rounds=rounds, dims=dims)
    kept = [(i, e) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    want, c = lloyd(kept, k, rounds)
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    most = 2**63 - 1
    inertia = Counter()
    for _, j, d in want:
        inertia[j] += min(d, most)
    expected = [(i, j, min(d, most), min(inertia[j], most), min(sum(inertia.values()), most), digest[j]) for i, j, d in want]
    assert sorted(map(tuple, got), key=lambda x: (x[0] or 0, x[1:])) == sorted(expected, key=lambda x: (x[0] or 0, x[1:]))


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(400)]
    equal_to_plain(spark, rows, k=5, rounds=4, dims=6)


def test_clusters_with_ties_repeats_and_missing_values(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 40, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(120)]  # few different vectors: many exact ties
    rows += [(None, [0.0, 1.0, 0.5]), (200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [-0.0, 0.0, 0.0])]
    equal_to_plain(spark, rows, k=4, rounds=6, dims=3)


@pytest.mark.parametrize("size", [2.0**20, 2.0**30, 2.0**60, 3e38])
def test_clusters_of_large_components_are_exact(spark, size):
    """Beyond what float32, int64 and doubles hold; neighbours that only exact arithmetic tells apart."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(size + rng.integers(-3, 4) / 1024), float(-size), float(rng.integers(-3, 4) / 1024)]) for i in range(60)]
    equal_to_plain(spark, rows, k=4, rounds=3, dims=3)


def test_intervals_hold_the_exact_value():
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e3, 1e6, 1e9):
        c = clusters.Centroids([[int(x) for x in r] for r in rng.normal(size=(9, 64)) * 1024 * scale])
        x = np.floor(rng.normal(size=(50, 64)) * 1024 * scale)
        low, high = c.intervals(x)
        exact = np.array([[sum(int(z) ** 2 for z in y) - 2 * sum(int(p) * int(q) for p, q in zip(row, y, strict=True)) for y in c.exact] for row in x], object)
        assert all(low[i, j] <= float(exact[i, j]) <= high[i, j] for i in range(50) for j in range(9))
        if scale <= 1e3:
            assert c.assign(x)[1] < 50 * 9  # the screening leaves few to recompute


def test_few_or_no_vectors(spark):
    assert clustered(spark, []) == []
    equal_to_plain(spark, [(3, [0.5, 1.0]), (9, [0.5, 1.0])], k=8, rounds=3, dims=2)


# --- substring removal -----------------------------------------------------------------------------------------------


def without_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 11, 20, 35])
def test_substrings_equal_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(window, 3 * window + 2))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 2 * window))] for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w for p in parts for w in p))
    texts += ["x " * (window - 1), "x " * (window + 3), "", " \t\n", "É é é\x1cz", *texts[:3]]
    d = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, block string, n_words int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(d, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == without_repeats(texts, window)


def test_substrings_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(150_000))  # over 1 MB, a block of its own
    rows = [(1, None), (2, ""), (3, long), (4, "one two"), (None, "a b c " * 20), (5, "a b c " * 20), (5, "a b c " * 20), (6, "z" * 1_100_000), (7, long[:599_998])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert (by[1][0]["n_words"], by[1][0]["kept"], by[2][0]["n_words"], by[6][0]["n_removed"]) == (0, "", 0, 0)
    assert by[5][0] == by[5][1] and by[5][0]["n_removed"] == 60 == by[None][0]["n_removed"]
    whole = len(long[:599_998].split()) - 1  # the last word is cut
    assert by[3][0]["n_removed"] == whole and [tuple(x) for x in by[3][0]["removed"]] == [(0, whole)]
    assert by[7][0]["kept"] == long[:599_998].split()[-1]
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("v", sorted(substrings.COVERS))
def test_covers_hold_every_difference(v):
    assert {(j - i) % v for i in substrings.COVERS[v] for j in substrings.COVERS[v]} == set(range(v))


@pytest.mark.parametrize("m", [1, 2, 3, 7, 15, 16, 35])
def test_span_hashes_tell_spans_apart(m):
    h = counting.stir(np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64))
    got = substrings.span_hashes(h, m)
    spans = [tuple(h[i : i + m]) for i in range(len(h) - m + 1)]
    assert len(got) == len(spans) and len(set(zip(spans, got.tolist(), strict=True))) == len(set(spans)) == len(set(got.tolist()))


def test_one_passage_in_every_document_stays_cheap(spark):
    """A hot passage reaches a key range once a block, not once a document."""
    d = spark.range(4000).selectExpr("id as doc_id", "concat(repeat('same old words ', 20), 'number ', id) as text").coalesce(4)
    got = substrings.remove_repeats(d).selectExpr("sum(n_removed)", "count(*)", "count(distinct kept)").first()
    assert tuple(got) == (4000 * 61, 4000, 4000)  # 'number' goes along


# --- messages ---


@pytest.mark.parametrize("step", [1, 7, 2400])
@pytest.mark.parametrize("top", [0, 1, 2**9, 2**31, 2**52 - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_ascending_numbers_come_back(n, top, step):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, top, n, endpoint=True)).astype(np.uint64)
    for y in (x * np.uint64(step) + np.uint64(5), np.arange(n, dtype=np.int64) * step):
        assert (counting.ascended(counting.ascending(y, step)) == y).all() and len(counting.ascended(counting.ascending(y, step))) == n
    assert n < 5000 or len(counting.ascending(x)) * 8 <= n * (3 + max(0, np.log2(max(1, top / n)))) + 200


def test_keys_of_any_size_come_back():
    rng = np.random.default_rng(3)
    for a, b in ((2**64, 2**32), (2**20, 2**16), (2**33, 2**31), (2**33, 2**32), (1, 2**64), (2**64, 1), (3, 3)):
        x, y = rng.integers(0, a - 1, 900, np.uint64, endpoint=True), rng.integers(0, b - 1, 900, np.uint64, endpoint=True)
        x[:2], y[:2] = (0, a - 1), (b - 1, b - 1)
        order = np.lexsort((y, x))
        got = counting.keys_unpacked(*counting.keys_packed(x[order], y[order]))
        assert (got[0] == x[order]).all() and (got[1] == y[order]).all()


def test_messages_and_replies_are_small(spark):
    """Pairs of 2^16 phrases and words, about a fifth of them frequent: under 24 bits a key sent, 12 a key answered."""
    rng = np.random.default_rng(4)
    key = np.unique(np.r_[rng.integers(0, 2**32, 40_000), np.arange(10_000) * 400_009])
    a, b = (key >> 16).astype(np.uint64), (key & 0xFFFF).astype(np.uint64)
    order, _ = counting.arranged(a, b, 2)
    n = np.where(key % 400_009 == 0, 9, 1)
    sent = [counting.messages(i, a[order], b[order], n[order], 2) for i in range(3)]
    assert sum(len(r[c]) for r in sent[0].to_pylist() for c in ("a", "b", "n")) * 8 < 24 * len(key)
    told = counting.tally(spark.createDataFrame([tuple(r.values()) for t in sent for r in t.to_pylist()], counting.MESSAGE), 27, 2, True)
    replies = told.where("block >= 0").toPandas()
    want = np.flatnonzero(n[order] == 9)
    ids = []
    for i in range(3):
        mine = counting.pa.Table.from_pandas(replies[replies["block"] == i])
        place, each, lead = counting.places(mine)
        assert (place == want).all() and len(set(each.tolist())) == len(want) and lead.all() == (i == 0) and lead.any() == (i == 0)
        ids.append(each.tolist())
        assert sum(len(r[c]) for r in mine.to_pylist() for c in ("place", "id", "lead")) * 8 < 12 * len(want)
    assert ids[0] == ids[1] == ids[2]
    lead = {i: (x, y, f) for r in told.where("block = -1").collect() for i, x, y, f in zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("id", "a", "b", "f")), strict=True)}
    assert [lead[i] for i in ids[0]] == [(x, y, 27) for x, y in zip(a[order][want].tolist(), b[order][want].tolist(), strict=True)]


# --- collocations ----------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, longest, top):
    said, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            said[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = defaultdict(list)
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), a in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    for (lang, p), a in frequent.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * said[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, ph.decode(), -a, left, right, said[lang], -s) for lang, x in out.items() for i, (s, a, ph, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (2, 3, 7), (1, 2, 50), (5, 4, 3)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    rng = random.Random(least)
    words = ["the", "The", "of", "a", "é", "É", "naïve", "x y", "z\x1c", "tea", "cup", "日本"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", ",", "\n", "  ", "!", "\x0b", ":?"]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", "und", None]), text))
    rows += [("en", None), ("en", ""), (None, "one"), ("de", " \t"), *rows[:4]]
    d = spark.createDataFrame([(i, lang, t, "c", 1, "w") for i, (lang, t) in enumerate(rows)], "id long, lang string, text string, phrase string, n int, word string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(d, least=least, longest=longest, top=top).collect())
    assert got == plain_collocations(rows, least, longest, top)


def test_collocations_of_long_and_no_texts(spark):
    d = spark.createDataFrame([("en", "ab cd " * 100_000), ("en", "ef " * 120), (None, None)], "lang string, text string")
    got = phrases.collocations(d).collect()
    assert [(r["phrase"], r["a"]) for r in got if r["phrase"].startswith("ef")] == [(" ".join(["ef"] * m), 121 - m) for m in (2, 3, 4, 5)]
    assert {r["phrase"]: r["a"] for r in got if r["phrase"].startswith("ab")}["ab cd ab cd"] == 99_999
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3_000_000_017
    got = spark.range(1).selectExpr(f"{big}L as a", f"{big * 7}L as n", f"{big + 11}L as l", f"{big + 5}L as r").selectExpr(phrases.SCORE).first()[0]
    assert got == 1000 * big * big * 7 // ((big + 11) * (big + 5))


# --- caches of the other operators -----------------------------------------------------------------------------------


def test_unspaced_words_leave_no_memory_behind():
    """5000 words of 20 KB each pass through the word caches of near copies, mixing and secrets."""
    import tracemalloc

    from spanweave.llm import jaccard, mixing, secrets

    words = [bytes([97 + i % 26]) * 20_000 + str(i).encode() for i in range(50)]
    gains = secrets._Gains(secrets.model())
    tracemalloc.start()
    for i in range(100):
        for w in words:
            long = w + str(i).encode()
            assert jaccard._words[long] == jaccard._words[long] and mixing._buckets[long] == mixing._buckets[long]
        gains[words[i % 50].decode() + "=x" + str(i)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20_000_000


def test_packed_sets_keep_all_bits():
    from spanweave.llm import jaccard

    s = np.unique(np.random.default_rng(2).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (jaccard._unpacked(jaccard._packed(s)) == s).all()
