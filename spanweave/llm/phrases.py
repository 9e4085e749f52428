"""Collocations: frequent phrases by vertical positional lists, scored by their weakest cut.

Documents are dealt into blocks. A block keeps, for every phrase that it holds, the list of positions at which it occurs.
Phrases grow one word at a time: the positions of a frequent phrase are merge-joined with the postings of the adjacent
word, that is with the positions, one word on, of the frequent phrases that end with that word (a phrase whose rest is
rare cannot be frequent). The length of a list is the phrase's exact frequency in the block; the sum over all blocks comes
from packed messages (`counting`), and each block is told which of its lists go on. A phrase is known by numbers, its
first part's and its last word's, so every row has the same size, however long the words.

Lists and texts are written in buckets of their block: they are never shuffled, only keys, counts and answers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, cut, delete, drop_bucketed, tidy
from .counting import MESSAGE, arranged, blocks, messages, packed, places, ranges, tally, unpacked

#: Pieces of a text end at these characters: . , ; : ! ? and \n to \r. The byte 0xFF, which UTF-8 lacks, stands for an end.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
_END = b"\xff"

#: floor(1000 * a * n / (l * r)): decimal products of 38 digits, and their whole quotient.
SCORE = "(cast(1000 * a as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(19,0)))"

LISTS = "block long, a binary, b binary, size binary, at binary, word_id array<long>, word_lang array<string>, word array<string>, lang array<string>, lang_words array<long>"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text (A-Z lower-cased) and piece ends."""
    return text.lower().translate(_ENDS).replace(_END, b" \xff ").split()


class _Words:
    """A block's words: `code` per position (-1: an end), and per code the language, the word, its hash and its count."""

    def __init__(self, got: pa.Table):
        got = got.sort_by("row")
        langs, texts = got.column("lang").to_pylist(), got.column("text").cast(pa.binary()).to_pylist()
        codes, self.words, self.langs, self.said = [], [], [], {}
        for lang in sorted(set(langs)):
            found = tokens(_END.join(t for one, t in zip(langs, texts, strict=True) if one == lang and t))
            number = {_END: -1}
            mine = np.fromiter((number.setdefault(w, len(number) - 1) for w in found), np.int64, len(found))
            self.said[lang] = int((mine >= 0).sum())
            codes += [np.where(mine >= 0, mine + len(self.words), -1), np.array([-1])]
            self.words += list(number)[1:]
            self.langs += [lang] * (len(number) - 1)
        self.code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        keys = b"".join(xxhash.xxh3_128_digest(lang.encode() + _END + w) for lang, w in zip(self.langs, self.words, strict=True))
        keys = np.frombuffer(keys, np.uint64).reshape(-1, 2)
        self.a, self.b = keys[:, 0], keys[:, 1] >> np.uint64(32)
        self.count = np.bincount(self.code[self.code >= 0], minlength=len(self.words))


def grown(at: np.ndarray, phrase: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of occurrences (ascending positions, the phrase that starts there, its last word) with those one word on:
    (position, phrase, adjacent word) of every occurrence that goes on."""
    on = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[on], phrase[on], last[on + 1]


def _listed(block: int, at: np.ndarray, phrase: np.ndarray, word: np.ndarray, count: int) -> dict:
    """Position lists per (phrase, word), in the order of `arranged`."""
    a, b = phrase.astype(np.uint64), word.astype(np.uint64)
    order, start = arranged(a, b, count)
    size = np.diff(np.r_[start, len(order)])
    return {"block": block, "a": packed(a[order][start]), "b": packed(b[order][start]), "size": packed(size), "at": packed(at[order])}


_LISTS = pa.schema(
    [("block", pa.int64()), *[(c, pa.binary()) for c in ("a", "b", "size", "at")], ("word_id", pa.list_(pa.int64())), ("word_lang", pa.list_(pa.string())), ("word", pa.list_(pa.string())),
     ("lang", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64()))]
)


def _row(values: dict) -> pa.Table:
    return pa.Table.from_arrays([pa.array([values.get(f.name, [] if pa.types.is_list(f.type) else b"")], f.type) for f in _LISTS], schema=_LISTS)


def _frequent(words: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, lang, parts, f) of frequent phrases of 1, 2, ... words, and (lang, n) of all words said. `words` is dropped
    once the lists of two words are written."""
    by_block = lambda x: x.groupBy("block")
    letters = words.agg(F.sum(F.length("text"))).first()[0] or 0
    count = ranges(letters / 20)

    def said(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Words(pa.Table.from_batches(list(batches)))
        order, _ = arranged(w.a, w.b, count)
        yield from messages(key[0].as_py(), w.a[order], w.b[order], w.count[order], count).to_batches()

    def pairs(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts):
            return _LISTS.empty_table()
        w = _Words(texts)
        order, _ = arranged(w.a, w.b, count)
        found, ids, leads = places(replies)
        number = np.full(len(w.words) + 1, -1, np.int64)
        number[order[found]] = ids
        at = np.flatnonzero(number[w.code] >= 0)  # code -1 is the last entry, an end
        mine = number[w.code[at]]
        named = order[found[leads]]
        told = {"word_id": ids[leads], "word_lang": [w.langs[i] for i in named], "word": [w.words[i].decode("utf-8", "replace") for i in named], "lang": list(w.said), "lang_words": list(w.said.values())}
        return _row(_listed(key[0].as_py(), *grown(at, mine, mine), count) | told)

    def longer(key: tuple, lists: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(lists) or not len(replies):
            return _LISTS.empty_table()
        row = lists.slice(0, 1).to_pylist()[0]
        size, at, last = (unpacked(row[c]).astype(np.int64) for c in ("size", "at", "b"))
        found, ids, _ = places(replies)
        number = np.full(len(size), -1, np.int64)
        number[found] = ids
        of = np.repeat(np.arange(len(size)), size)
        on = np.flatnonzero(number[of] >= 0)
        on = on[np.argsort(at[on], kind="stable")]
        return _row(_listed(key[0].as_py(), *grown(at[on], number[of[on]], last[of[on]]), count))

    def sent(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, size in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b", "size")), strict=True):
                yield from messages(block, unpacked(a), unpacked(b), unpacked(size), count).to_batches()

    def named(replies: DataFrame) -> DataFrame:
        """(id, a, b, f) of the keys found."""
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for each in zip(*(batch.column(c).to_pylist() for c in ("id", "a", "b", "f")), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in each], ["id", "a", "b", "f"])

        return replies.where("block = -1").select("id", "a", "b", "f").mapInArrow(unpack, "id long, a long, b long, f long")

    answer = lambda r: by_block(r.where("block >= 0").select("block", "place", "id", "lead"))
    replies = cut(tally(by_block(words.select("block", "row", "lang", "text")).applyInArrow(said, MESSAGE), least, count, True), "replies")
    lists = bucketed(by_block(words).cogroup(answer(replies)).applyInArrow(pairs, LISTS), "block", "lists")
    drop_bucketed(words)
    n = cut(lists.select(F.inline(F.arrays_zip("lang", "lang_words"))).groupBy("lang").agg(F.sum("lang_words").alias("n")), "n")
    single = lists.select(F.inline(F.arrays_zip("word_id", "word_lang", "word"))).select(F.col("word_id").alias("id"), F.col("word_lang").alias("lang"), F.array("word").alias("parts"))
    out = [cut(single.join(named(replies).select("id", "f"), "id"), "words")]
    last = out[0].select(F.col("id").alias("b"), F.col("parts").alias("added"))
    for size in range(2, longest + 1):
        before = replies
        replies = cut(tally(by_block(lists.select("block", "a", "b", "size")).applyInArrow(sent, MESSAGE), least, count, True), "replies")
        delete(before.sparkSession, before._spanweave_path)
        found = named(replies).join(out[-1].select(F.col("id").alias("a"), "lang", "parts"), "a").join(last, "b")
        out.append(cut(found.select("id", "lang", F.concat("parts", "added").alias("parts"), "f"), "phrases"))
        if size < longest:
            older, lists = lists, bucketed(by_block(lists.select("block", "b", "size", "at")).cogroup(answer(replies)).applyInArrow(longer, LISTS), "block", "lists")
            drop_bucketed(older)
    drop_bucketed(lists)
    return out, n


@tidy
def collocations(df: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the `top` phrases of 2 to `longest` words by score.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and \\n to \\r, and pieces into words at spaces and tabs.
    Within a language (null: `und`): n counts its words, a the phrase's occurrences within pieces, overlaps included; only
    phrases with a >= least count. Cut after its first words a phrase scores floor(1000 * a * n / (l * r)), with l and r the
    occurrences of both parts; its lowest cut counts, ties: the shortest first part. A phrase inside a longer one (up to
    `longest` words) that occurs as often is left out. Order: score and a descending, then the phrase by bytes. Products are
    exact up to 38 digits, that is for n and a up to 10^15. Null, empty and blank texts say nothing; an empty table gives no
    rows; repeated rows count each. Words are told apart by 96 bits of hash.

    Tables of frequent phrases hold at most one row per `least` words said and length; they stay in Spark.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be 2 or more, least 1 or more")
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = bucketed(blocks(rows, "text", ["lang", "text"]), "block", "words")
    found, n = _frequent(words, least, longest)
    told = [x.select("lang", "parts", F.array_join("parts", " ").alias("phrase"), "f") for x in found]
    every, many = told[0], told[1]
    for x in told[1:]:
        every = every.union(x)
    for x in told[2:]:
        many = many.union(x)
    part = lambda side: every.select("lang", F.col("phrase").alias(f"{side}_phrase"), F.col("f").alias(side))
    size = F.size("parts")
    cuts = many.select("lang", "parts", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("l_phrase"), F.array_join(F.slice("parts", F.col("k") + 1, size - F.col("k")), " ").alias("r_phrase"))
    cuts = cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(n, "lang")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("low"))
    inner = many.where(size > 2).select("lang", "f", "parts", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "f", "parts", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", "f", F.array_join(F.slice("parts", F.col("s"), F.col("m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("inside is null or 100 * inside < 100 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    kept = kept.select("lang", rank.alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    return kept.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
