"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; FILTERS learned filters, WIDTH bytes wide with stride 2, run over the whole document. Each chunk of
1024 bytes (half of it shared with the next) is max-pooled per filter, rectified and combined linearly; the mean over
all chunks passes through the logistic function to one probability. For scoring, embedding and filter weights fold into
tables of byte pairs, so a filter position costs WIDTH / 2 look-ups. Training is Adam on a bounded sample of labelled
documents; only the arg-max positions carry gradient.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim

FILTERS, WIDTH, EMBED = 16, 6, 8
#: Positions in half a chunk (a position is two bytes), and positions handled at once.
HALF, BLOCK = 256, 1 << 16
#: Training: labelled documents per class at most, passes, and the bytes that a document enters with at most: from longer
#: ones PIECES pieces, evenly spread over the whole, are put together. Scoring covers whole texts.
SAMPLE, PASSES, SAMPLE_BYTES, PIECES = 1200, 10, 16_384, 16

Model = tuple[np.ndarray, np.ndarray, np.ndarray, float]  # tables (WIDTH, 256, FILTERS), filter bias, output weights, output bias


def _pairs(data: bytes) -> np.ndarray:
    """Byte pairs, zero-padded so that every window is whole; one window at least."""
    n = max(1, -(-len(data) // 2))
    return np.frombuffer(data.ljust(2 * (n + WIDTH // 2 - 1), b"\0"), "<u2")


@functools.lru_cache(maxsize=2)
def _pair_tables(raw: bytes) -> list[np.ndarray]:
    t = np.frombuffer(raw, np.float32).reshape(WIDTH, 256, FILTERS)
    return [(t[i + 1][:, None, :] + t[i][None, :, :]).reshape(65536, FILTERS) for i in range(0, WIDTH, 2)]


def _start(raw: bytes) -> list[np.ndarray]:
    claim("quality", _pair_tables.cache_clear)
    return _pair_tables(raw)


def chunk_maxima(data: bytes, tables: list[np.ndarray]) -> np.ndarray:
    """(chunks, FILTERS): the largest response of each filter in each chunk, before bias."""
    u = _pairs(data)
    n = len(u) - WIDTH // 2 + 1
    halves = []
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        x = tables[0].take(u[at : at + m], 0)
        for i in range(1, WIDTH // 2):
            x += tables[i].take(u[at + i : at + i + m], 0)
        full = m // HALF * HALF
        if full:
            halves.append(x[:full].reshape(-1, HALF, FILTERS).max(1))
        if full < m:
            halves.append(x[full:].max(0)[None])
    h = np.concatenate(halves)
    return np.maximum(h[:-1], h[1:]) if len(h) > 1 else h


def probability(data: bytes, model: Model, tables: list[np.ndarray]) -> float:
    _, bias, out, c = model
    z = float((np.maximum(chunk_maxima(data, tables) + bias, 0) @ out).mean()) + c
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: list[int], share: float | None = None, seed: int = 3, passes: int = PASSES) -> Model:
    """Fit on whole byte strings, both classes weighted alike; then the odds of `share`, the share of label 1 among all
    labels (default: among these), are restored, so that the output is a probability. Without both classes: a constant at the share of label 1 (1 if there are no rows)."""
    y = np.array(labels, float)
    zero = np.zeros((WIDTH, 256, FILTERS), np.float32)
    if len(set(labels)) < 2:
        share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)  # not the labels' share: nothing was learnt
        return zero, np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share)))
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, 0.4, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.3, FILTERS), "c": np.zeros(1)}
    m1, m2, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(passes):
        for batch in np.array_split(r.permutation(len(texts)), max(1, len(texts) // 32)):
            t = np.einsum("be,wef->wbf", p["e"], p["w"])
            flat = _pair_tables(t.astype(np.float32).tobytes())
            g, gt = {k: np.zeros_like(x) for k, x in p.items()}, np.zeros_like(t)
            for i in batch:
                u, n = _pairs(texts[i]), max(1, -(-len(texts[i]) // 2))
                x = sum(flat[j].take(u[j : j + n], 0) for j in range(WIDTH // 2))
                starts = range(0, max(1, n - HALF), HALF)
                top = np.array([s + x[s : s + 2 * HALF].argmax(0) for s in starts])
                a = x[top, np.arange(FILTERS)] + p["b"]
                act = np.maximum(a, 0)
                err = (1 / (1 + np.exp(-np.clip(float((act @ p["v"]).mean()) + p["c"][0], -30, 30))) - y[i]) * weight[i] / len(batch)
                g["c"] += err
                g["v"] += err * act.mean(0)
                d = err * p["v"] * (a > 0) / len(top)
                g["b"] += d.sum(0)
                b = u.view(np.uint8)
                for j in range(WIDTH):
                    np.add.at(gt[j], (b[2 * top + j], np.arange(FILTERS)[None].repeat(len(top), 0)), d)
            g["e"] = np.einsum("wbf,wef->be", gt, p["w"])
            g["w"] = np.einsum("be,wbf->wef", p["e"], gt)
            step += 1
            for k in p:
                g[k] += 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    share = float(np.clip(y.mean() if share is None else share, 1e-3, 1 - 1e-3))
    t = np.einsum("be,wef->wbf", p["e"], p["w"]).astype(np.float32)
    return t, p["b"].astype(np.float32), p["v"].astype(np.float32), float(p["c"][0] + np.log(share / (1 - share)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], list[int], float | None]:
    """(texts, labels, share of label 1 among all that may be read). At most `sample` labelled documents per class, the first
    by hash of the id, with at most `most` bytes each (see SAMPLE_BYTES); rows whose crc32(id) mod 5 is 0 are never read.
    Several labels of one id: the smallest; several texts: the smallest. The ids are bounded, so they are broadcast."""
    i, t = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    known = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(i.cast("string")) % 5 != 0)).groupBy(i.alias("id")).agg(F.min(label_col).alias("label"))
    ids = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    step, size = F.expr(f"cast(octet_length(t) div {PIECES} as int)"), most // PIECES
    spread = F.concat(*(F.substring(F.col("t"), F.lit(k) * step + 1, F.lit(size)) for k in range(PIECES)))
    texts = docs.select(i.alias("id"), t.alias("t"))
    rows = texts.join(F.broadcast(ids[0].union(ids[1])), "id").select("id", F.when(F.octet_length("t") <= most, F.col("t")).otherwise(spread).alias("t"), "label")
    rows = rows.groupBy("id", "label").agg(F.min("t").alias("t")).select("id", "t", "label").collect()
    rows = sorted((r[0], bytes(r[1]), int(r[2])) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows], known.agg(F.avg("label")).first()[0]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the text's bytes enter a score; null text is empty, and an empty text is one chunk of zeros. Repeated rows
    score alike. Without labels of both classes the score is constant (see `train`). Empty table: no rows.
    """
    model = train(*training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    raw = model[0].tobytes()

    def run(batches):
        tables = _start(raw)
        for batch in batches:
            texts = batch.column(1)
            scores = [probability((t.as_py() or "").encode("utf-8", "surrogatepass"), model, tables) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = df.mapInArrow(run, f"doc_id {df.dtypes[0][1]}, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3, **names) -> DataFrame:
    """`docs` without the rows that the classifier rejects (score under `threshold`); all columns stay."""
    model = train(*training_rows(docs, labels, text_col=text_col, **names))
    raw = model[0].tobytes()

    def run(series):
        tables = _start(raw)
        for s in series:
            yield s.map(lambda t: probability((t or "").encode("utf-8", "surrogatepass"), model, tables))

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(run, "double")(F.col(text_col).cast("string")) >= threshold)
