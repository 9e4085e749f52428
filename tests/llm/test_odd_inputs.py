"""Every corpus operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; the
pipeline against its parts."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from spanweave.llm import chat, jaccard, links, mixing, neighbours, packing, pii, quality, secrets
from spanweave.llm.common import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _label int, _kept int, _chosen int, r string, id long, t string, v string, n long, key long, tokens long, topic string, label int, spans string, k int"
LABELS = "doc_id long, quality int, _id string, _label int, id string, t string, label int"
LONG = "alpha beta gamma " * 60_000


def table(spark, rows):
    extra = ("x", 1, 2, 3, "y", 4, "z", "w", 5, 6, 7, "u", 8, "q", 9)
    return spark.createDataFrame([(i, t, lang, source, None, *extra) for i, t, lang, source in rows], COLUMNS)


ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "one two three four five six seven", "en", "a"), (4, "one two three four five six seven", "en", "a"), (5, "One two three four five six seven", "de", None), (None, "one two three four five six seven", "de", "b"), (6, " \t\n", "en", "b")]


def labels(spark):
    return spark.createDataFrame([(3, 1, *("x", 0, "y", "z", 1)), (4, 1, *("x", 0, "y", "z", 0)), (5, 0, *("x", 1, "y", "z", 1)), (None, 1, *("x", 0, "y", "z", 1)), (2, None, *("x", 0, "y", "z", 1))], LABELS)


OPERATORS = {
    "pii": lambda s, d: pii.pii_digests(pii.find_pii(d)),
    "mask_pii": lambda s, d: pii.mask_pii(d),
    "jaccard": lambda s, d: jaccard.jaccard_classes(d),
    "drop_near_copies": lambda s, d: jaccard.drop_near_copies(d),
    "calibrated": lambda s, d: mixing.calibrated(d),
    "mix": lambda s, d: mixing.mix(d),
    "pack": lambda s, d: packing.pack(d, TOKENIZER),
    "secrets": lambda s, d: secrets.secret_digests(secrets.find_secrets(d)),
    "mask_secrets": lambda s, d: secrets.mask_secrets(d),
    "score_quality": lambda s, d: quality.score_quality(d, labels(s)),
    "keep_quality": lambda s, d: quality.keep_quality(d, labels(s)),
    "chat": lambda s, d: chat.format_chats(d, ["doc_id", "r", "_id"], record="text"),
    "records": lambda s, d: chat.records_of_rows(d, "doc_id", "n", "source", "text"),
    "urls": lambda s, d: links.judge_pages(d, id_col="doc_id", url_col="text", html_col="text", rounds=2),
}
PER_ROW = ("pii", "mask_pii", "calibrated", "secrets", "mask_secrets", "score_quality", "chat", "urls")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = table(spark, ROWS)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in PER_ROW:
        key = out.columns[0]
        assert sorted((r[key] or 0) for r in rows) == sorted((i or 0) for i, *_ in ROWS)
        four = [r for r in rows if r[key] == 4]
        assert four[0] == four[1]  # repeated rows fare alike
    if name in ("mask_pii", "mask_secrets", "drop_near_copies", "mix", "keep_quality"):
        assert out.columns == docs.columns
        texts = {(i, t) for i, t, *_ in ROWS}
        assert {(r.doc_id, r.text) for r in rows} <= texts  # nothing to mask
    if name == "jaccard":
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {1: (0, 1), 2: (0, 2), 3: (3, 3), 4: (3, 4), 5: (3, 4), 6: (0, 6)}
    if name == "drop_near_copies":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 4, 6]
    if name == "pack":
        assert sum(r.length for r in rows if r.doc_id in (1, 2, 6)) == 3 and sum(r.length for r in rows if r.doc_id == 3) > 180_000
        assert sum(r.length for r in rows if r.doc_id == 4) == 2 * sum(r.length for r in rows if r.doc_id is None)
    if name in ("score_quality", "keep_quality", "chat"):
        assert len(rows) <= len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark, table(spark, ROWS).limit(0))
    assert out.count() == 0 and len(out.columns) > 1


def test_equal_ids_with_different_texts_are_one_document(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "z y x w v u", "en", "s"), (2, "z y x w v u", "en", "s"), (3, "a b c d e f", "en", "s")]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(table(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_many_members_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common[: 40 + i % 20], *(f"x{i // 3}y{j}" for j in range(i % 5))]), "en", "s") for i in range(120)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(table(spark, rows)).collect()}
    sets = [set(jaccard.shingles(t, 5).tolist()) for _, t, _, _ in rows]
    root = list(range(120))
    for _ in range(120):
        for i in range(120):
            for j in range(i):
                if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[i] == root[j] for i in range(120) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
            break
    assert got == dict(enumerate(root))


VECTORS = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, []), (62, [float("inf"), 0.0, 0.0]), (63, [None, 0.0, 0.0]), (64, [0.0, 0.0, 0.0]), (7, [0.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (65, [1.0])]


@pytest.mark.parametrize("search", [neighbours.top_inner_products, neighbours.multi_index_search])
def test_vectors(spark, search):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in VECTORS], "vec_id long, embedding array<double>, id int, block int, cell string")
    got = {}
    for r in search(df, lambda i: i % 10 == 0, k=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {i: np.array(v) for i, v in VECTORS[:60]} | ({64: np.zeros(3)} if search is neighbours.top_inner_products else {})
    assert set(got) == {0, 10, 20, 30, 40, 50}
    for q, found in got.items():
        def far(j):
            return -int(1024 * 1024 * vectors[q] @ vectors[j]) if search is neighbours.top_inner_products else float(np.sqrt(((vectors[q] - vectors[j]) ** 2).sum()))
        want = sorted((far(j), j) for j in vectors if j != q)[:60]
        assert sorted(found) == [(n + 1, j, abs(s)) for n, (s, j) in enumerate(want)]
    assert search(df.where("vec_id < 0"), lambda i: i % 10 == 0).count() == 0 == search(df, lambda i: i < 0).count()


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(edges, rounds=1)


def test_pipeline(spark, tmp_path):
    r = np.random.default_rng(3)
    words = ["the", "heed", "onan", "thin", "sator", "arepo", "tenet", "opera", "rotas", "verum", "lorem", "ipsum"]
    rows, quality_of = [], []
    for i in range(120):
        good = " ".join(words[j] for j in r.integers(0, 12, 60))
        text = good if i % 3 else good.replace(" ", "$$$ ")
        rows.append((i, text + (" call (415) 555-2671 or a.b@c.example.org" if i % 4 == 1 else ""), "en" if i % 2 else "de", f"s{i % 5}", len(text)))
        quality_of.append((i, int(i % 3 > 0), 0))
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(40)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quality_of, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "pii", "mixing", "packing"]
    columns, held = docs.columns, {x.doc_id: x for x in docs.collect()}
    scores = {x.doc_id: x.score for x in quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    want = {i for i in held if scores[i] >= 0.3}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = {x.doc_id: x for x in docs.collect()}
        if name == "near_copies":  # the copies have the ids from 200 on
            want = {i for i in want if not (200 <= i < 240 and i - 200 in want)}
        if name == "pii":
            held = {i: x.asDict() | {"text": x.text and x.text.replace("(415) 555-2671", "<PHONE>").replace("a.b@c.example.org", "<EMAIL>")} for i, x in held.items()}
            assert all(now[i].asDict() == held[i] for i in now)
        if name == "mixing":
            assert set(now) < want or len(want) < 3
            want = set(now)
        assert set(now) == want, name
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    assert {x.doc_id for x in pieces} == want
    for i in want:
        ids = np.array([*tok.encode(held[i]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((x for x in pieces if x.doc_id == i), key=lambda x: x.start)
        assert [x.ids_crc32 for x in mine] == [zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in mine] and sum(x.length for x in mine) == len(ids)


def test_a_worker_keeps_the_caches_of_one_operator():
    jaccard._start()
    jaccard.shingles("a b c")
    mixing._start()
    assert not jaccard._words
    mixing.counts_of("a b")
    packing._chunks(TOKENIZER)
    assert not mixing._buckets and packing._loaded
    quality._start(np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32).tobytes())
    assert not packing._loaded
