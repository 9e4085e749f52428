"""Removal of word sequences that occur more than once, found through difference-cover anchors.

Positions of a document are seen modulo a period v. The cover D holds, for every difference d, two members that differ by
d modulo v; so wherever two equal windows of `window` words start, there is a shift below v at which both positions fall
on the cover. Only there are words hashed: anchors of window - v + 1 words, which such a shift keeps inside the window.
Anchors that occur once end there. The others are extended to all windows around them (up to v placements each), and a
window is repeated if its whole sequence of words is met elsewhere. Pairs are never formed: both steps count keys of 96
bits (`counting`), so a passage in a third of all documents costs no more per copy than any other.

Texts stay where they are: they are written once in buckets of their block, and every pass reads them by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, drop_bucketed, tidy
from .counting import MESSAGE, arranged, blocks, joined, messages, places, ranges, tally

#: Difference covers by period (perfect difference sets).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def period(window: int) -> int:
    """The longest period that leaves anchors a third of the window, or one word."""
    return max(v for v in COVERS if v <= max(1, (2 * window + 2) // 3))


def span_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all spans of m neighbours, from hashes of spans of 1, 2, 4, ... of them."""
    if len(h) < m:
        return np.empty(0, np.uint64)
    out, done, step, size = None, 0, h, 1
    while True:
        if m & size:
            out = step if out is None else joined(out[: len(step) - done], step[done:])
            done += size
        if done == m:
            return out[: len(h) - m + 1]
        step = joined(step[:-size], step[size:])
        size *= 2


class _Block:
    """The words of a block's documents, one after another."""

    def __init__(self, got: pa.Table, window: int, count: int):
        self.window, self.count, self.v = window, count, period(window)
        self.got = got.sort_by("row")
        texts = self.got.column("text").cast(pa.binary()).to_pylist()
        self.words = [t.split() if t else [] for t in texts]  # bytes.split() splits at space and \t to \r
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        total = int(self.length.sum())
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for ws in self.words for w in ws), np.int64, total)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in number), np.uint64).reshape(-1, 2)
        self.h1, self.h2 = digests[code, 0], digests[code, 1]  # spans are told apart by 64 bits of one and 32 of the other
        self.place = np.arange(total) - np.repeat(self.start, self.length)
        self.room = np.repeat(self.length, self.length) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the anchors, and their hashes."""
        m = self.window - self.v + 1
        on = np.isin(np.arange(self.v), COVERS[self.v])
        long = np.repeat(self.length >= self.window, self.length)
        at = np.flatnonzero(on[self.place % self.v] & (self.room >= m) & long)
        return at, span_hashes(self.h1, m)[at], span_hashes(self.h2, m)[at] >> np.uint64(32)

    def shared(self, replies: pa.Table) -> np.ndarray:
        """Which words start an anchor that occurs elsewhere."""
        at, a, b = self.anchors()
        return self._marked(at, a, b, replies)

    def windows(self, anchored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold a shared anchor, and their hashes."""
        below = np.r_[0, np.cumsum(anchored)]
        last = np.minimum(np.arange(len(anchored)) + self.v, len(anchored))
        at = np.flatnonzero((self.room >= self.window) & (below[last] > below[:-1]))
        return at, span_hashes(self.h1, self.window)[at], span_hashes(self.h2, self.window)[at] >> np.uint64(32)

    def _marked(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, replies: pa.Table) -> np.ndarray:
        out = np.zeros(len(self.h1), bool)
        order, start = arranged(a, b, self.count)
        found = np.zeros(len(start), bool)
        found[places(replies)[0]] = True
        out[at[order][np.repeat(found, np.diff(np.r_[start, len(order)]))]] = True
        return out

    def repeated(self, anchored: np.ndarray, replies: pa.Table) -> np.ndarray:
        """Which words lie in a window that occurs elsewhere."""
        starts = self._marked(*self.windows(anchored), replies)
        ends = np.r_[np.zeros(self.window, np.int64), starts][: len(starts)] if len(starts) else starts
        return np.cumsum(starts.astype(np.int64) - ends) > 0


def _sent(block: int, a: np.ndarray, b: np.ndarray, count: int) -> pa.Table:
    order, start = arranged(a, b, count)
    return messages(block, a[order][start], b[order][start], np.diff(np.r_[start, len(order)]), count)


def _level(replies: pa.Table, level: int) -> pa.Table:
    return replies.filter(pa.array(np.asarray(replies.column("level").to_pylist(), int) == level))


_OUT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@tidy
def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): `kept` holds the words of a text that no repeated window covers, joined by
    one space; `removed` the spans of the others (word numbers, end exclusive).

    A window is `window` consecutive words of one document (a word: no space, no \\t to \\r); it is repeated if its words
    also start anywhere else, in the same document too. Null, empty and shorter texts lose nothing; a null text keeps the
    empty string. Rows are judged one by one, so two rows with the same id and text are copies of each other; a null id
    stays null. Other columns play no part. Empty table: no rows. Keys are compared by 96 bits of hash.

    Memory of a task: the words of one block (about 4 million characters, or one longer text), about 100 bytes a word.
    """
    if window < 1:
        raise ValueError("window must be positive")
    numbered = blocks(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", ["doc_id", "text"])
    kept = bucketed(numbered, "block", "texts")
    letters = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    count = ranges(letters / 20)

    def anchors(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, a, b = _Block(pa.Table.from_batches(list(batches)), window, count).anchors()
        yield from _sent(key[0].as_py(), a, b, count).to_batches()

    def windows(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts) or not len(replies):
            return _sent(key[0].as_py(), np.empty(0, np.uint64), np.empty(0, np.uint64), count)
        block = _Block(texts, window, count)
        _, a, b = block.windows(block.shared(replies))
        return _sent(key[0].as_py(), a, b, count)

    def clean(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(texts, window, count)
        gone = block.repeated(block.shared(_level(replies, 1)), _level(replies, 2)) if len(replies) else np.zeros(len(block.h1), bool)
        kept, removed, lost = [], [], []
        for words, s, n in zip(block.words, block.start, block.length, strict=True):
            mine = gone[s : s + n]
            lost.append(int(mine.sum()))
            if not lost[-1]:
                kept.append(b" ".join(words))
                removed.append([])
                continue
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~mine)]))
            edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).reshape(-1, 2)
            removed.append([{"start": int(x), "end": int(y)} for x, y in edges])
        columns = [block.got.column("doc_id"), pa.array(block.length), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, _SPANS)]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    by_block = lambda x: x.groupBy("block")
    first = cut(tally(by_block(kept.select("block", "row", "text")).applyInArrow(anchors, MESSAGE), 2, count, False), "anchors")
    found = by_block(kept.select("block", "row", "text")).cogroup(by_block(first.select("block", "place", "id", "lead"))).applyInArrow(windows, MESSAGE)
    second = cut(tally(found, 2, count, False), "windows")
    level = lambda x, n: x.select("block", "place", "id", "lead", F.lit(n).alias("level"))
    replies = level(first, 1).union(level(second, 2))
    out = cut(by_block(kept).cogroup(by_block(replies)).applyInArrow(clean, _OUT), "cleaned")
    drop_bucketed(kept)
    return out.withColumnRenamed("doc_id", id_col)
