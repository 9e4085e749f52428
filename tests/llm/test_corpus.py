"""The corpus operators against brute force, exact round trips or held-out accuracy, and on odd inputs."""

import hashlib
import itertools
import json
import random
import re
import time
import warnings
import zlib

import numpy as np
import public_tokenizers
import pytest

from spanweave.llm import chat, jaccard, links, mixing, neighbours, packing, pii, quality, queries, secrets
from spanweave.llm.common import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)], DOCS)


def brute_components(texts, size, num, den):
    sets = [set(jaccard.shingles(t, size).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        o = len(sets[i] & sets[j])
        if o and den * o >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for n, lost, new in ((600, 5, 9), (1000, 40, 90), (5000, 0, 300), (5000, 900, 0), (600, 0, 0), (2000, 1900, 7000)):
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[lost:], r.integers(0, 2**64, new, dtype=np.uint64)]))
        x, y = (jaccard._fine(v) or jaccard._parity(v).tobytes() for v in (x, y))
        assert jaccard._fine_apart(x, y) == jaccard._fine_apart(y, x) <= lost + new
        assert (jaccard._fine_apart(x, y) == 0) == (lost + new == 0)
    assert jaccard._fine(np.arange(512, dtype=np.uint64)) is None


@pytest.mark.parametrize(("num", "den", "size"), [(90, 100, 3), (8, 10, 5)])
def test_jaccard_classes(spark, num, den, size):
    r = random.Random(num)
    words = [f"w{i}" for i in range(60)]
    shared = " ".join(r.choice(words) for _ in range(40))
    texts = [None, "", " \t", "one", "One", "two words", "TWO  words"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(5, 120))] + (shared.split() if r.random() < 0.6 else [])
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    want = brute_components(texts, size, num, den)
    for frequent in (1, 3, 64):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(docs(spark, texts), size=size, num=num, den=den, frequent=frequent).collect()}
        assert got == want


def test_jaccard_on_an_empty_table(spark):
    assert jaccard.jaccard_classes(docs(spark, ["x"]).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2), (8, 9)], "a long, b long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_pii_base_spans_are_the_patterns():
    r = random.Random(1)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    for _ in range(3000):
        t = "".join(r.choice("a@.1 -+2()9é") for _ in range(r.randint(0, 40)))
        got = pii.base_spans(t)
        for kind, p in patterns.items():
            want = [m for m in re.finditer(p, t)]
            digits = lambda m: re.sub("[^0-9]", "", m.group())
            if kind == "ip":
                want = [m for m in want if all(int(x) <= 255 for x in m.group().split("."))]
            if kind == "card":
                want = [m for m in want if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
            if kind == "phone":
                want = [m for m in want if 9 <= len(digits(m)) <= 15]
            assert [(s, e) for k, s, e, _ in got if k == kind] == [m.span() for m in want], (kind, t)


def test_pii_decoding_is_the_best_segmentation():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        segs = [(i, min(n - 1, i + r.randint(0, 3)), r.choice("ab"), r.uniform(-1, 2)) for i in range(n) for _ in range(2)]
        best = max(sum(s[3] for s in c) for k in range(n + 1) for c in itertools.combinations(segs, k) if all(a[1] < b[0] or b[1] < a[0] for a, b in itertools.combinations(c, 2)))
        score = {(i, j + 1, k): s for i, j, k, s in sorted(segs, key=lambda s: s[3])}
        found = pii.decode([(i, j + 1, k, s) for i, j, k, s in segs])
        assert abs(sum(score[x] for x in found) - best) < 1e-9 and all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def found_by_pii(texts, writings):
    w, hit, total, wrong = pii.weights(), 0, 0, 0
    for text, spans in pii.examples(texts, seed=99, writings=writings):
        base = [(s, e) for _, s, e, _ in pii.base_spans(text)]
        want = {x for x in spans if not any(s < x[2] and x[1] < e for s, e in base)}
        got = {(k, s, e) for k, s, e, _ in pii.model_spans(text, w, base)}
        hit, total, wrong = hit + len(got & want), total + len(want), wrong + len(got - want)
    return hit / total, wrong / total


def test_pii_recall_of_writings_that_training_has_not_seen(spark):
    assert not {x for v in pii.UNSEEN.values() for x in v} & {x for v in pii.WRITINGS.values() for x in v}
    for writings in (pii.WRITINGS, pii.UNSEEN):
        recall, wrong = found_by_pii(400, writings)
        assert recall >= 0.95 and wrong <= 0.02
    rows = [(t, s) for t, s in pii.examples(60, seed=5, writings=pii.UNSEEN)]
    got = pii.find_pii(docs(spark, [t for t, _ in rows])).collect()
    added = sum((k, s, e) in {(x.kind, x.start, x.end) for x in r.spans if not x.base} for r in got for k, s, e in rows[r.doc_id][1])
    assert added >= 0.8 * sum(len(s) for _, s in rows)  # some are base spans
    out = pii.mask_pii(docs(spark, ["mail a.b@c.example.org now", None, "", "call (415) 555-2671 please"])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["mail <EMAIL> now", None, "", "call <PHONE> please"]


def test_pii_model_is_the_best_segmentation_of_all_segments():
    w, seen = pii.weights(), 0
    for text, _ in [*pii.examples(40, seed=3, writings=pii.UNSEEN), ("", []), ("at", []), ("a at b.c", []), ("1 2 3 4 5 6 7 8 9", []), ("(415) 555-2671 (415) 555-2672", [])]:
        scored = {}
        for s, e, groups in pii.candidates(text):
            for kind in pii.KINDS:
                x = w.get((kind, "bias"), 0.0) + sum(w.get((kind, y), 0.0) for g in groups for y in pii.features(g))
                if x > 0:
                    scored[s, e, kind] = x
        if len(scored) > 14:
            continue
        seen += bool(scored)
        best = max(sum(scored[x] for x in c) for n in range(len(scored) + 1) for c in itertools.combinations(scored, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2)))
        assert abs(sum(scored[s, e, k] for k, s, e, _ in pii.model_spans(text, w, [])) - best) < 1e-9
    assert seen > 5


def test_spans_of_very_long_texts():
    for find in (pii.finder(), secrets.finder()):
        for text in ("host 10.1.2.3 ok " * 60_000, "1 2 3 " * 50_000, "a@b" * 200_000, "x" * 1_000_000, "pwd = x7Kq2mZp9LtW " * 10_000):
            began = time.time()
            find(text)
            assert time.time() - began < 10


def found_by_chain(n, **kw):
    fitted, hit, total, wrong = secrets.model(), 0, 0, 0
    for text, spans in secrets.examples(n, seed=98, **kw):
        got = set(secrets.model_spans(text, fitted))
        hit, total, wrong = hit + len(got & set(spans)), total + len(spans), wrong + len(got - set(spans))
    return hit / total, wrong / total


def test_secrets(spark):
    for kw in ({}, {"prefixes": secrets.UNSEEN_PREFIXES, "announced": secrets.UNSEEN_ANNOUNCED, "bare": secrets.UNSEEN_BARE}):
        recall, wrong = found_by_chain(300, **kw)
        assert recall >= 0.95 and wrong <= 0.02
    t = 'x Api_Key = "abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef0 token:short'
    row = secrets.secret_digests(secrets.find_secrets(docs(spark, [t, None, "Authorization: Bearer qWeRtYuIoPaSdFgHjKlZxCvBnM"]))).orderBy("doc_id").collect()
    listed = "assign:2:25,access:27:45,hex:46:63"
    assert t[2:25] == 'Api_Key = "abcdefghijkl' and (row[0].n_assign, row[0].n_access, row[0].n_hex) == (1, 1, 1)
    assert row[0].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and row[1].spans == "" and row[2].spans == "secret:22:48"


def test_secret_base_spans_are_the_patterns():
    r = random.Random(8)
    patterns = {
        "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18), "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    }
    for _ in range(2000):
        t = "".join(r.choice(("token", "API_key", "Secret=", ":", "= ", "'", "AKIA", "ABCDEFG12", "0123456789abcdef", "x", " ", "é", "abcdef", "passwd", "ſecret: abcdefghijklmn")) for _ in range(r.randint(0, 12)))
        got = secrets.base_spans(t)
        for kind, (p, fits) in patterns.items():
            assert [(s, e) for k, s, e, _ in got if k == kind] == [m.span() for m in re.finditer(p, t, re.A) if fits(m)], (kind, t)


def test_secrets_clear_of_base_spans():
    r = random.Random(9)
    for _ in range(300):
        base = sorted((("hex", a, a + r.randint(1, 9), True) for a in r.sample(range(60), 6)), key=lambda x: x[1])
        at, found = 0, []
        while at < 60:
            s = at + r.randint(0, 6)
            at = s + r.randint(1, 5)
            found.append((s, at))
        assert secrets.clear_of(found, base) == [(s, e) for s, e in found if not any(a < e and s < b for _, a, b, _ in base)]


def test_secrets_without_digits_or_short():
    fitted = secrets.model()
    for before, key in (("Authorization: Bearer ", "qWeRtYuIoPaSdFgHjKlZxCvBnM"), ("private_key: ", "kJhGfDsAqPwOeIrUtYzMxNcBvL"), ("pwd = ", "x7Kq2mZp9LtW"), ("auth ", "Zk4vQ9sT1bXw")):
        text = f"see the note, {before}{key} and the rest"
        assert (len(text[: text.index(key)]), text.index(key) + len(key)) in secrets.model_spans(text, fitted), key


def test_secrets_are_those_of_the_whole_chain():
    fitted = secrets.model()
    w, trans, start = fitted
    texts = [t for t, _ in secrets.examples(60, seed=97)]
    for text in [*texts, " ".join(texts[:20]), "pwd = x7Kq2mZp9LtW", "a", "x7Kq2mZp9LtWx7Kq2mZp9LtW " * 9]:
        m = list(secrets._TOKEN.finditer(text))
        tokens, whole, want = [x.group() for x in m], secrets.file_features(text), []
        u = np.array([sum((w[f] for f in secrets._observed(tokens, t, whole) if f in w), np.zeros(3)) for t in range(len(m))])
        for x, tag in zip(m, secrets.viterbi(u, trans, start), strict=True):
            if tag == 1:
                want.append(x.span())
            elif tag == 2:
                want[-1] = (want[-1][0], x.end())
        assert secrets.model_spans(text, fitted) == want


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(50):
        u, t, s = r.normal(size=(4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
        value = lambda p: s[p[0]] + sum(u[i, p[i]] for i in range(4)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert abs(value(secrets.viterbi(u, t, s)) - max(value(p) for p in itertools.product(range(3), repeat=4))) < 1e-9


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", "a\\b [ROLE]x[/ROLE] <\\", "é\n\\\\[<", None]
    rows = spark.createDataFrame([(c, t, role, texts[(c + t) % 5]) for c in range(4) for t, role in enumerate(("system", "user", "assistant", "to[ol", "assistant"))], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(chat.records_of_rows(rows), ["conv_id"]), ["conv_id"])
    for r in back.collect():
        want = [(role, texts[(r.conv_id + t) % 5] or "") for t, role in enumerate(("system", "user", "assistant", "to[ol", "assistant"))]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")


def test_chat_layouts(spark):
    records, want = {}, {}
    turns = [("user", "p"), ("assistant", "c")]
    values = {"prompt": "p", "completion": "c", "response": "c", "instruction": "p", "output": "c", "question": "p", "answer": "c", "input": "q", "system": "s"}
    for name, fields in chat.LAYOUTS.items():
        record = {}
        for f, _ in fields:
            if f in chat.LISTS:
                a, b = chat.LISTS[f]
                record[f] = [{a: x if f == "messages" else {"user": "human", "assistant": "gpt"}[x], b: y} for x, y in turns]
            else:
                record[f] = values[f]
        records[name] = json.dumps(record | {"extra": 1})
        want[name] = ([("system", "s")] if "system" in record else []) + ([("user", "p\n\nq"), turns[1]] if "input" in record else turns)
    df = spark.createDataFrame(list(records.items()), "r string, record string")  # r: also a name inside the operator
    made = chat.format_chats(df, ["r"])
    assert {x.r: x.layout for x in made.collect()} == {name: name for name in records} and len(records) == 16
    assert {x.r: [tuple(t) for t in x.turns] for x in chat.read_back(made, ["r"]).collect()} == want


def test_chat_odd_records(spark):
    cases = [
        ('{"messages":[{"role":"user","content":null},{"content":"x","role":"assistant"},{"role":"tool","content":[{"type":"text","text":"a"},{"type":"image"},"b"]}]}', "messages", None, [("user", ""), ("assistant", "x"), ("tool", "ab")]),
        ('{"messages":[{"content":"x"}]}', "messages", None, [("", "x")]), ('{"messages":[]}', "messages", None, []), ('{"prompt":"p","completion":null}', "prompt_completion", None, [("user", "p"), ("assistant", "")]),
        ('{"prompt":[{"role":"system","content":"s"},{"role":"user","content":"u"}],"completion":[{"content":"c"}]}', "prompt_completion", None, [("system", "s"), ("user", "u"), ("assistant", "c")]),
        ('{"instruction":"i","input":"","output":"o"}', "instruction_input_output", None, [("user", "i"), ("assistant", "o")]), ('{"prompt":"[1]","response":5}', "prompt_response", None, [("user", "[1]"), ("assistant", "5")]),
        ('{"prompt":"x","prompt":"y","completion":"z"}', "prompt_completion", None, [("user", "y"), ("assistant", "z")]), ('{"other":1}', None, "unknown", []), ('{"messages":["a"]}', None, "unknown", []),
        ("{", None, "malformed", []), ("[1]", None, "malformed", []), ("", None, "malformed", []), (None, None, "null", []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] * 2, "i int, record string")
    made = chat.format_chats(df, ["i"])
    got = made.collect()
    assert len(got) == 2 * len(cases) and all((x.layout, x.problem) == cases[x.i][1:3] for x in got)
    assert all([tuple(t) for t in x.turns] == cases[x.i][3] for x in chat.read_back(made, ["i"]).collect())
    long = json.dumps({"messages": [{"role": "user", "content": "x" * 18_000_000}, {"role": "assistant", "content": "y"}]})  # beyond a variant
    row = chat.format_chats(spark.createDataFrame([(1, long)], "i int, record string"), ["i"]).selectExpr("layout", "length(formatted) n").first()
    assert row.layout == "messages" and row.n == 18_000_000 + 6 + 4 + 7 + 1 + 4


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    r = random.Random(4)
    texts = [" ".join(r.choice(("The", "heed,", "éa's", "on***", "x<|endoftext|>y", "12a", "İst", "a\x1cb")) for _ in range(r.choice((0, 1, 3, 40, 900, 3000)))) for _ in range(40)] + [None, ""]
    rows = packing.pack(docs(spark, texts).repartition(3), TOKENIZER, capacity=2048).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for x in sorted((x for x in rows if x.doc_id == i), key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for _, g in itertools.groupby(sorted(rows, key=lambda x: (x.sequence_id, x.offset)), key=lambda x: x.sequence_id):
        at = 0
        for x in g:
            assert x.offset == at
            at += x.length
        assert at <= 2048
    sizes = {}
    for x in rows:
        sizes[x.sequence_id] = sizes.get(x.sequence_id, 0) + x.length
    assert sum(n < 1024 for n in sizes.values()) <= 1  # open bins are put together


def test_gathered_bins_hold_all_and_no_more():
    r = random.Random(10)
    for _ in range(50):
        bins = [(k, r.randint(1, 2048)) for k in r.sample(range(1, 129), r.randint(0, 60))]
        out, held = packing.gathered(bins, 2048), {}
        for k, home, shift in sorted(out, key=lambda x: (x[1], x[2])):
            assert shift == held.get(home, 0)
            held[home] = shift + dict(bins)[k]
        assert sorted(k for k, _, _ in out) == sorted(k for k, _ in bins) and all(n <= 2048 for n in held.values())


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    chunks, tok = packing._Chunks(path), Tokenizer.from_file(path)
    assert not chunks.chunked and packing._Chunks(TOKENIZER).chunked
    for t in ("Two  words\n", " a", "x"):
        assert chunks.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_fill_their_slots():
    for n in range(1, 5000, 7):
        p = packing.pieces_of(n, 2048)
        assert sum(x for x, _ in p) == n and all(x <= 2048 // k for x, k in p)


def test_top_inner_products(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 6)), 2)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in neighbours.top_inner_products(df, lambda i: i % 10 == 0, k=5).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    q = np.floor(1024 * x).astype(int)
    for i in range(0, 300, 10):
        want = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert set(got) == set(range(0, 300, 10))
    assert neighbours.top_inner_products(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_products_are_exact_at_any_size(spark):
    rows = [[2**30 + i, 2**29 - 3 * i, (-1) ** i] for i in range(40)]  # products around 2^60 after scaling by 1, ties below one unit of a double
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {}
    for g in neighbours.top_inner_products(df, lambda i: i % 10 == 0, k=5, scale=1).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    dot = lambda i, j: sum(a * b for a, b in zip(rows[i], rows[j], strict=True))
    for i in range(0, 40, 10):
        want = sorted((-dot(i, j), j) for j in range(40) if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)] and -want[0][0] > 2**53
    big = neighbours.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 0.0], [-(2.0**40), 0.0], [2.0**21, 5.0]]))
    assert big.tolist() == [[2**63 - 1, -(2**63), 2**61 + 5]]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_products_with_many_groups_and_parts(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "SLICE", 8)
    monkeypatch.setattr(neighbours, "PART", 64)
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 12))
    x = np.round(centres[r.integers(0, 30, 1500)] + spread * r.normal(size=(1500, 12)), 3)
    x[700:760] = x[700]  # ties, and a hot cell of queries
    asks = lambda i: ((i % 25) == 0) | i.between(700, 760)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in neighbours.top_inner_products(df, asks, pivots=30).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    q = np.floor(1024 * x).astype(int)
    queries = [i for i in range(1500) if i % 25 == 0 or 700 <= i <= 760]
    assert sorted(got) == queries
    for i in queries:
        want = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:10]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]


def test_tight_groups_need_few_rows():
    r = np.random.default_rng(4)
    p = 1000 * r.normal(size=(30, 12))
    near = {c: [1.0] * 11 for c in range(30)}
    groups = neighbours._Groups(p, near, {c: (2000, 5.0) for c in range(10)}, 10)  # SLICE is exceeded: a group per cell
    x = p[r.integers(0, 30, 2000)] + r.normal(size=(2000, 12))
    assert groups.needed(x).mean() < 0.1


def test_multi_index_visits_little_of_clustered_data():
    r = np.random.default_rng(1)
    c = r.normal(size=(200, 32))
    x = c[r.integers(0, 200, 4000)] + 0.15 * r.normal(size=(4000, 32))
    y = x @ neighbours.rotation(x)
    assert np.allclose(neighbours.squared(x[:9], x), neighbours.squared(y[:9], y))
    halves = [neighbours.centroids(h, 16) for h in (y[:, :16], y[:, 16:])]
    assert neighbours.visit_share(y, halves, 10, 0.96) < 0.1


def test_multi_index_recall(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 16), (5001, None)], "vec_id long, embedding array<double>")
    hit = total = 0
    found = neighbours.multi_index_search(df, lambda i: i % 50 == 0).collect()
    for i in range(0, 1500, 50):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.argsort(dist, kind="stable") if j != i][:10]
        mine = {g.vec_id: g.score for g in found if g.query_id == i}
        assert len(mine) == 10 and all(abs(s - dist[j]) < 1e-12 for j, s in mine.items())
        hit, total = hit + len(set(want) & set(mine)), total + 10
    assert hit >= 0.9 * total


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/8#f", "ftp://x.net/de/8", "http://example.net/de/81", "http://b.org/es/", "nothing", None, "http://c.io", "http://notexample.com/en/7"]
    df = spark.createDataFrame([(i, u, '<a href="http://b.org/x">') for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in links.judge_pages(df, rounds=4).orderBy("page_id").collect()]
    assert got[:5] == [("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("x.net", "/de/8", "net/de/", "block"), ("example.net", "/de/81", "example.net/de/8", "allow"), ("b.org", "/es/", "org/es/", "block")]
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("c.io", "", None) and got[8][2] == "com/en/"
    assert got[7][3] == "block"  # it links to a blocked host
    assert links.judge_pages(df.union(df), rounds=4).count() == 2 * len(urls)  # repeated rows stay


def test_url_verdicts_are_those_of_the_whole_graph(spark):
    r = random.Random(11)
    hosts = [f"h{i}.io" for i in range(20)] + ["a.h1.io", "b.a.h1.io", "bad.org", "good.example.com", "x.bad.org"]
    rows = []
    for h in hosts:
        for _ in range(r.randint(1, 3)):
            path = "/es/" if h.endswith("bad.org") and r.random() < 0.7 else "/en/7" if h == "good.example.com" else "/z"
            rows.append((len(rows), f"http://{h}{path}", " ".join(f'<a href="http://{r.choice(hosts)}/q">' for _ in range(r.randint(0, 3)))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = {}
    known = {}
    for _, url, html in rows:
        src = url[7:].split("/")[0]
        known[src] = None
        for dst in re.findall(r"http://([^/]+)/q", html):
            known[dst] = None
            if dst != src:
                w[src, dst] = w.get((src, dst), 0) + 1
    for h in list(known):
        while h.count(".") > 1:
            up = h.split(".", 1)[1]
            known[up] = None
            w.setdefault(("step", h, up), links.PARENT)
            h = up
    names = list(known)
    m = np.zeros((len(names),) * 2)
    for key, x in w.items():
        m[names.index(key[-2]), names.index(key[-1])] += x
    rank = {}
    for kind, a, fits in (("trust", m, "/en/7"), ("distrust", m.T, "/es/")):
        seed = np.zeros(len(names))
        for _, url, _ in rows:
            h, _, path = url[7:].partition("/")
            if "/" + path == fits:
                seed[names.index(h)] += 1
        seed /= seed.sum()
        out = a.sum(1)
        p = np.where(out[:, None] > 0, a / np.where(out > 0, out, 1)[:, None], seed)
        v = seed
        for _ in range(300):
            v = 0.15 * seed + 0.85 * v @ p
        rank[kind] = dict(zip(names, v, strict=True))
    got = links.judge_pages(df).collect()
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}
    for x in got:
        assert abs(x.trust - rank["trust"][x.host]) < 1e-4 and abs(x.distrust - rank["distrust"][x.host]) < 1e-4
        if x.rule is None and abs(rank["trust"][x.host] - rank["distrust"][x.host]) > 1e-4:
            assert x.verdict == ("block" if rank["distrust"][x.host] > rank["trust"][x.host] else "allow")


def test_url_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/8": ("com/en/", "block"), "http://Example.com/en/7": ("example.com/en/7", "allow"),
        "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://net/de/": ("net/de/", "allow"), "http://x.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://c.example.net/de/81?q": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://d.org/es/x#f": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_url_filter_on_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert links.judge_pages(df.limit(0), rounds=1).count() == 0


def test_url_verdicts_do_not_depend_on_the_number_of_hosts(spark):
    page = lambda to: f'<a href="http://{to}/x">'
    rows = [("http://bad.org/es/", None)] + [(f"http://h{i}.io/", page("bad.org")) for i in range(12_000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert links.judge_pages(df).where("verdict <> 'block'").count() == 0


def test_distrust_reaches_far_hosts(spark):
    rows = [("http://bad.org/es/", None), ("http://h0.io/", '<a href="http://bad.org/x">')] + [(f"http://h{i}.io/", f'<a href="http://h{i - 1}.io/">') for i in range(1, 25)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert links.judge_pages(df).where("verdict <> 'block'").count() == 0


def test_spread_against_dense(spark):
    r = random.Random(5)
    edges = sorted({(k, f"h{r.randint(0, 11)}", f"h{r.randint(0, 11)}") for k in ("trust", "distrust") for _ in range(30)})
    edges = [(k, s, d, float(r.randint(1, 4))) for k, s, d in edges if s != "h3"]  # h3 leads nowhere
    seeds = [("trust", "h0", 0.25), ("trust", "h3", 0.75), ("distrust", "h1", 1.0)]
    got = {(x.kind, x.host): x.rank for x in links.spread(spark.createDataFrame(edges, "kind string, src string, dst string, w double"), spark.createDataFrame(seeds, "kind string, host string, seed double"), rounds=100).collect()}
    for kind in ("trust", "distrust"):
        w = np.zeros((12, 12))
        for k, s, d, x in edges:
            if k == kind:
                w[int(s[1:]), int(d[1:])] += x
        v = np.zeros(12)
        for k, h, x in seeds:
            if k == kind:
                v[int(h[1:])] = x
        out = w.sum(1)
        p = np.where(out[:, None] > 0, w / np.maximum(out, 1)[:, None], v)  # dangling mass returns to the seeds
        rank = v
        for _ in range(300):
            rank = 0.15 * v + 0.85 * rank @ p
        assert all(abs(got.get((kind, f"h{i}"), 0.0) - rank[i]) < 1e-6 for i in range(12))


def test_raking(spark):
    cells = spark.createDataFrame([("a", "x", 0, 100), ("a", "y", 1, 300), ("b", "x", 1, 400), ("b", "y", 0, 200)], "source string, lang string, topic int, tokens long")
    target = lambda **kv: spark.createDataFrame(list(kv.items()), "value string, target double")
    targets = {"source": target(a=0.5, b=0.5), "lang": target(x=0.45, y=0.55), "topic": spark.createDataFrame([("0", 0.35), ("1", 0.65)], "value string, target double")}
    rows = mixing.rake(cells, targets, keep=0.5, rounds=60, tolerance=1e-6).join(cells, ["source", "lang", "topic"]).collect()
    total = sum(r.tokens * r.probability for r in rows)
    for by, wanted in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"x": 0.45, "y": 0.55}), ("topic", {0: 0.35, 1: 0.65})):
        for v, t in wanted.items():
            assert abs(sum(r.tokens * r.probability for r in rows if r[by] == v) / total - t) < 1e-3
    assert all(0 <= r.probability <= 1 for r in rows)


def test_raking_against_dense_fitting(spark):
    r = np.random.default_rng(12)
    tokens = r.integers(1, 900, (4, 3, 5))
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", k, int(tokens[i, j, k])) for i, j, k in np.ndindex(4, 3, 5)], "source string, lang string, topic int, tokens long")
    share = [tokens.sum(tuple({0, 1, 2} - {d})) ** 0.8 for d in range(3)]
    share = [x / x.sum() for x in share]
    names = ([f"s{i}" for i in range(4)], [f"l{i}" for i in range(3)], [str(i) for i in range(5)])
    targets = {by: spark.createDataFrame([(v, float(x)) for v, x in zip(n, s, strict=True)], "value string, target double") for by, n, s in zip(mixing.DIMENSIONS, names, share, strict=True)}
    w = 0.3 * tokens.astype(float)
    for _ in range(200):
        for d in range(3):
            w *= np.expand_dims(0.3 * tokens.sum() * share[d] / w.sum(tuple({0, 1, 2} - {d})), tuple({0, 1, 2} - {d}))
    want = w / tokens
    assert want.max() < 1
    for few in (0, 1000):  # in Spark, and as arrays
        for x in mixing.rake(cells, targets, keep=0.3, tolerance=1e-7, few=few).collect():
            assert abs(x.probability - want[int(x.source[1:]), int(x.lang[1:]), x.topic]) < 1e-5


def test_both_ways_of_raking_agree(spark):
    r = random.Random(13)
    for n in (0, 1, 12):
        rows = [(f"s{i % 4}", f"l{i % 3}", i % 5, r.choice((0, 1, 10, 500))) for i in range(n)]
        cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long").dropDuplicates(["source", "lang", "topic"])
        values = (["s0", "s1", "s2"], ["l0", "l1", "l2"], ["0", "1", "2", "3", "4", "9"])
        targets = {by: spark.createDataFrame([(v, 1 / len(vs)) for v in vs], "value string, target double") for by, vs in zip(mixing.DIMENSIONS, values, strict=True)}
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            a, b = ({tuple(x[:3]): x.probability for x in mixing.rake(cells, targets, rounds=6, few=few).collect()} for few in (0, 1000))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_raking_takes_rare_values_whole(spark):
    cells = spark.createDataFrame([("rare", "x", 0, 10), ("a", "x", 0, 400), ("a", "y", 1, 300), ("b", "x", 1, 90), ("b", "y", 0, 200)], "source string, lang string, topic int, tokens long")
    target = lambda **kv: spark.createDataFrame(list(kv.items()), "value string, target double")
    targets = {"source": target(rare=0.1, a=0.6, b=0.3), "lang": target(x=0.5, y=0.5), "topic": spark.createDataFrame([("0", 0.6), ("1", 0.4)], "value string, target double")}
    rows = mixing.rake(cells, targets, keep=0.5).join(cells, ["source", "lang", "topic"]).collect()
    expected = lambda by, v: sum(r.tokens * r.probability for r in rows if r[by] == v)
    for by, v, n in (("source", "rare", 10), ("source", "a", 490 * 2 / 3), ("source", "b", 490 / 3), ("lang", "x", 250), ("lang", "y", 250), ("topic", 0, 300), ("topic", 1, 200)):
        assert abs(expected(by, v) - n) <= 2e-3 * n, (by, v)


def test_topics_are_fitted_on_all_documents(spark):
    texts = [" ".join(f"t{i % 2}w{(i * k) % 23}" for k in range(1, 30)) for i in range(3000)] + [" ".join(f"rare{k}" for k in range(20))] * 6
    topics = {r.id: r.topic for r in mixing.measured(docs(spark, texts)).collect()}
    rare = {topics[i] for i in range(3000, 3006)}
    assert len(topics) == 3006 and len(rare) == 1 and not rare & {topics[i] for i in range(3000)}


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a b c", "s", "en"), (2, "a b c", "s", "en"), (None, "x", "s", "en")], DOCS)
    got = mixing.calibrated(df).collect()
    assert len(got) == 4 and len({r.sampled for r in got if r.doc_id == 2}) == 1 and not any(r.sampled for r in got if r.doc_id is None)


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(("the", "heed", "onan", "thin")) for _ in range(r.randint(5, 200)))
    texts = [good() if i % 2 else good().replace(" ", "$$$ ") for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.score_quality(docs(spark, texts), labels).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 400]
    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.95 * len(held)
    assert got[400].score == got[401].score and 0 <= got[400].score <= 1
    kept = quality.keep_quality(docs(spark, texts), labels)
    assert kept.columns == ["doc_id", "text", "source", "lang"] and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}


def test_chunks_cover_the_whole_text():
    model = (np.zeros((6, 256, 16), np.float32), np.zeros(16, np.float32), np.ones(16, np.float32), 0.0)
    model[0][0, ord("Z")] = 1.0
    tables = quality._pair_tables(model[0].tobytes())
    for at in (0, 1000, 199_998):
        text = bytearray(b"a" * 200_000)
        text[at] = ord("Z")
        assert quality.probability(bytes(text), model, tables) > 0.5


def test_scores_are_a_plain_convolution():
    r = np.random.default_rng(14)
    model = (r.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), r.normal(size=quality.FILTERS).astype(np.float32), r.normal(size=quality.FILTERS).astype(np.float32), 0.3)
    tables = quality._pair_tables(model[0].tobytes())
    for n in (0, 1, 2, 7, 511, 512, 513, 1024, 1025, 5000):
        data = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        places = max(1, -(-n // 2))
        padded = data + bytes(2 * places + quality.WIDTH)
        x = np.array([sum(model[0][i, padded[2 * t + i]] for i in range(quality.WIDTH)) for t in range(places)])
        chunks = [x[a : a + 2 * quality.HALF].max(0) for a in range(0, max(1, places - quality.HALF), quality.HALF)]
        z = np.mean([np.maximum(c + model[1], 0) @ model[2] for c in chunks]) + model[3]
        assert abs(quality.probability(data, model, tables) - 1 / (1 + np.exp(-z))) < 1e-4, n


def test_training_takes_long_texts_in_pieces(spark):
    long = "".join(chr(97 + i % 26) * 100 for i in range(2000))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 5)], "doc_id long, quality int")
    got, y, share = quality.training_rows(docs(spark, ["-", long, "short"]).where("doc_id > 0"), labels, most=1600)
    picked = {len(t): t for t in got}
    assert set(picked) <= {1600, 5} and len(got) == len(y)
    if 1600 in picked:  # sixteen pieces of a hundred bytes each, from all of the text
        assert [picked[1600][100 * k : 100 * k + 100].decode() for k in range(16)] == [long[12_500 * k : 12_500 * k + 100] for k in range(16)]
