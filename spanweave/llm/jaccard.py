"""N-gram Jaccard self-join by token-combination prefixes; connected classes of near copies.

Method. A document's set is hashed to 64-bit shingles, ordered by hash. Sets with similarity >= num/den have an overlap
of at least need = ceil(num/den * n) with either side, so the first e shingles that they share lie within the first
n - need + e of each (the prefix). Shingles that few documents have in their prefix ("rare") are indexed singly: that
finds every pair of which one side has fewer than e frequent shingles in its prefix. Documents with more extend their
prefix over the whole set, cut at fixed hash values into more stretches than two linked sets can differ in; the
combination of all shingles in a stretch is a key, and linked sets have one such combination in common (`stretches`).
Nothing is capped: a common key exists for every linked pair, whatever the frequencies. Candidates pass an exact bound
from parities of bucket counts (few buckets, then as many as shingles) and then an exact check.

Only classes are asked for: the documents under one key are compared with one leader (rows in proportion to the group),
and then only those that are still in different classes with each other. Under a single shingle at most FREQUENT
documents meet, under a combination any number.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, connected_components, cut, fresh, tidy

#: A shingle that more documents have in their prefix is frequent.
FREQUENT = 16
#: Members of one key that are compared within a task; more are dealt into blocks.
BLOCK = 256
#: Words of parity bits.
PARITY = 8

_WORD_CACHE = 250_000
#: Longer words (bytes) are hashed each time, so a full cache holds tens of megabytes whatever the words.
_LONGEST = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    """64-bit hashes of words; starts anew when full, and keeps short words only, so memory is bounded."""

    def __missing__(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(w) <= _LONGEST:
            if len(self) >= _WORD_CACHE:
                self.clear()
            self[w] = h
        return h


_words = _Words()


def _start() -> None:
    claim("jaccard", _words.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: maximal runs without space and \\t to \\r. bytes.lower and bytes.split touch ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words than `size`: the whole sequence; none: empty."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < size:
        size = n
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out * _M1 + h[i : n - size + 1 + i] * _M2 + _M3)
    return np.unique(out)


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with a linked one: intersection >= num/den * union >= num/den * n."""
    return -(-num * n // den)


def level(n: int, num: int, den: int) -> int:
    """Size level: sizes within a factor num/den fall in equal or neighbouring levels (the margin covers rounding)."""
    return math.floor(math.log(n) / (math.log(den / num) * 1.000001))


def stretches(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Keys of the combinations of a set: of its own size level, and of the next, where smaller and larger sets meet.

    Linked sets that meet at a level differ in at most d shingles in all, d <= (den - num)/num * n for either size n.
    Of d + 1 + z stretches of the hash range, 1 + z at least hold the same shingles in both. A set with at most z empty
    stretches so shares one that is not empty; a set with more also indexes its empty ones.
    """
    out = []
    own = level(len(s), num, den)
    mixed = _mix(s)
    for at in (own, own + 1):
        d = (den - num) * math.floor(math.exp((at + 1) * math.log(den / num) * 1.000001) + 1) // num
        spare_ones = d // 8
        count = d + 1 + spare_ones
        where = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        keys = []
        tag = np.uint64(at + 1) * _M2
        keys.append(_mix(np.add.reduceat(mixed, start) * _M1 + where[start] * _M3 + tag))
        if count - len(start) > spare_ones:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), where)
            keys.append(_mix(empty * _M1 + tag))
        out.append(np.concatenate(keys))
    return out


def spare(n: int, num: int, den: int) -> int:
    """e: how many shared shingles a prefix must hold; grows with n."""
    return 1 + (n - need(n, num, den)) // 3


def _odd(s: np.ndarray, buckets: int) -> np.ndarray:
    """Bits: whether a bucket of shingles has an odd count. Two sets differ in at least as many shingles as their parities
    differ in bits."""
    return np.packbits((np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).astype(np.uint8))


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY words of bits, for all sets."""
    return _odd(s, 64 * PARITY).view(np.int64)


def _fine(s: np.ndarray) -> bytes | None:
    """Parities of as many buckets as shingles or more (a power of two), where PARITY words are fewer: those say little there."""
    return _odd(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > 64 * PARITY else None


def _fine_apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded: bucket i of m/2 holds the buckets i and i + m/2 of m."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Linked sets differ in at most (den - num) / (den + num) of the sum of their sizes."""
    apart = sum((F.bit_count(F.col(f"{x}_parity")[i].bitwiseXOR(F.col(f"{y}_parity")[i])) for i in range(1, PARITY)), F.bit_count(F.col(f"{x}_parity")[0].bitwiseXOR(F.col(f"{y}_parity")[0])))
    return apart * (den + num) <= (F.col(f"{x}_n") + F.col(f"{y}_n")) * (den - num)


def _profile(size: int, num: int, den: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("parity", pa.list_(pa.int64())), ("fine", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        _start()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 512):
                rows = []
                for i, text in zip(ids[at : at + 512].to_pylist(), texts[at : at + 512].to_pylist(), strict=True):
                    s = shingles(text, size)
                    n = len(s)
                    p = min(n, n - need(n, num, den) + spare(n, num, den)) if n else 0
                    rows.append((i, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), _parity(s), _fine(s), s[:p].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(kinds)], schema=kinds)

    return run, "doc_id long, n long, sig binary, parity array<long>, fine binary, prefix array<long>"


#: Bytes of a shingle's hash in a packed set.
_KEPT = 8


def _packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").astype(np.uint64)


def _sets(size: int):
    def run(batches):
        _start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(shingles(t.as_py(), size)) for t in batch.column(1)], pa.binary())], names=["doc", "set"])

    return run


def _combinations(size: int, num: int, den: int):
    def run(batches):
        _start()
        for batch in batches:
            both = [stretches(shingles(x.as_py(), size), num, den) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i].view(np.int64) for k in both], pa.list_(pa.int64())) for i in (0, 1))], names=["doc", "own", "next"])

    return run


def _overlap(batches):
    """Exact size of the intersection for each pair of sets."""
    for batch in batches:
        both = [len(np.intersect1d(_unpacked(x.as_py()), _unpacked(y.as_py()), assume_unique=True)) for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), batch.column("a_n"), batch.column("b_n")], names=["a", "b", "both", "a_n", "b_n"])


def _close(pairs: DataFrame, profile: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (a, b) that the parities allow."""
    side = lambda c: profile.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))
    return _closer(cut(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b", num, den)).select("a", "b").distinct(), "close"), profile, num, den)


def _closer(pairs: DataFrame, profile: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the parities of many buckets allow; those only travel for pairs that the few words let pass."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_fine", "b_fine", "a_n", "b_n")), strict=True)
            yield batch.filter(pa.array([x is None or y is None or _fine_apart(x, y) * (den + num) <= (n + m) * (den - num) for x, y, n, m in rows], pa.bool_())).select(["a", "b"])

    side = lambda c: profile.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("fine").alias(f"{c}_fine"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct(), "closer")


def _sets_of(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(doc, set) of the documents in `pairs`: only their texts are read into sets."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    return cut(texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(size), "doc long, set binary"), "sets")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, a_n, b_n): exact overlap of the pairs (a, b)."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("set").alias(f"{c}_set"), (F.octet_length("set") / _KEPT).cast("long").alias(f"{c}_n"))
    found = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set", "a_n", "b_n").mapInArrow(_overlap, "a long, b long, both long, a_n long, b_n long")
    return cut(found, "overlaps")


@tidy
def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 8, den: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included), n_copies.

    Two documents link when intersection/union of their word-shingle sets is at least num/den; `n_copies` counts the
    documents with the very same set (itself included; 1 for empty sets). Null or blank text: an empty set, linked with
    nothing. Fewer words than `size`: the whole sequence is the one shingle. Rows of one id count as one document, with
    the greatest of their texts; rows without id are left out. Other columns are not read. Ties go to the smaller id. Empty table:
    no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    if docs.select(id_col).groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
    run, schema = _profile(size, num, den)
    profile = cut(texts.mapInArrow(run, schema), "profile")
    slim = profile.select("doc_id", "n", "sig").dropDuplicates(["doc_id"])
    full = slim.where("n > 0")
    classes = cut(full.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_copies")), "classes")
    reps = profile.where("n > 0").join(classes.select("doc"), F.col("doc_id") == F.col("doc"), "left_semi")
    reps = cut(reps.select(F.col("doc_id").alias("doc"), "n", "prefix").dropDuplicates(["doc"]), "reps")
    single = reps.select(F.explode("prefix").alias("key"), "doc")
    counts = cut(single.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = cut(single.join(counts, "key").join(reps.select("doc", "n"), "doc").select("key", "doc", "n", "df"), "shared")
    least = lambda n: F.floor((n * num + (den - 1)) / den).cast("long")  # noqa: E731  need()
    partner = least(F.col("n"))  # the smallest set that can be linked, and so the smallest e of a pair
    enough = F.floor((partner - least(partner)) / 3) + 1
    hot = cut(shared.where(F.col("df") > frequent).groupBy("doc", "n").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= enough).select("doc", "n"), "hot")
    near = lambda x, y: (F.least(x, y) * den >= F.greatest(x, y) * num)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    linked = F.col("both") * den >= (F.col("a_n") + F.col("b_n") - F.col("both")) * num
    # Keys: single rare shingles, and the combinations of documents whose prefix is mostly frequent.
    weight = shared.groupBy("doc", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("w")).select("doc", "w")
    few = shared.where(F.col("df") <= frequent).join(weight, "doc").select("key", F.lit(False).alias("up"), "doc", "n", "w")
    parts = texts.join(hot.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_combinations(size, num, den), "doc long, own array<long>, next array<long>")
    parts = parts.join(cut(hot.join(weight, "doc", "left").select("doc", "n", F.coalesce("w", F.lit(0.0)).alias("w")), "weights"), "doc")
    keys = few.union(parts.select(F.explode("own"), F.lit(False), "doc", "n", "w")).union(parts.select(F.explode("next"), F.lit(True), "doc", "n", "w"))
    keys = cut(keys, "keys")
    # The member with the largest shared part of its prefix leads, so that the middle of a group does.
    top = F.max(F.struct("w", (-F.col("doc")).alias("d"), "n"))
    lead = cut(keys.groupBy("key").agg((-top["d"]).alias("leader"), top["n"].alias("leader_n"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "lead")
    led = cut(keys.join(lead, "key"), "led")
    tried = _close(led.where("doc <> leader").where(near(F.col("n"), F.col("leader_n"))).select(*pair(F.col("leader"), F.col("doc"))).distinct(), profile, num, den)
    links = _overlaps(tried, _sets_of(texts, tried, size)).where(linked).select("a", "b")
    comp = cut(connected_components(links), "comp")
    # What is left: pairs under one key that are still in different classes.
    led = led.join(comp.select(F.col("id").alias("doc"), "component"), "doc", "left").select("key", "up", "doc", "n", F.coalesce("component", "doc").alias("c"))
    # A key with many members is dealt into blocks by hash: each member meets every block, in a task of its own.
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    open_keys = cut(led.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), blocks).where("lo <> hi").select("key", "blocks"), "open")
    led = cut(led.join(open_keys, "key"), "open")
    parity = profile.join(cut(led.select(F.col("doc").alias("doc_id")).distinct(), "ids"), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "parity").dropDuplicates(["doc"])
    led = cut(led.join(cut(parity, "parity"), "doc"), "open")
    sides = [F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")]
    x, y = (led.select("key", *(F.col(v).alias(f"{side}_{v}") for v in ("doc", "n", "c", "up", "parity")), block.alias("block")) for side, block in zip("xy", sides, strict=True))
    rest = x.join(y, ["key", "block"]).where((F.col("x_doc") < F.col("y_doc")) & (F.col("x_c") != F.col("y_c")) & ~(F.col("x_up") & F.col("y_up")) & near(F.col("x_n"), F.col("y_n")) & _may_link("x", "y", num, den))
    rest = cut(rest.select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    rest = _closer(rest, profile, num, den)
    links = links.union(_overlaps(rest, _sets_of(texts, rest, size)).where(linked).select("a", "b"))
    comp = cut(connected_components(links), "comp")
    classes = classes.join(comp.withColumnRenamed("id", "doc"), "doc", "left").select("sig", "n_copies", F.coalesce("component", "doc").alias("component_id"))
    out = slim.join(classes, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"))
    return out


@tidy
def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """`docs` with one document (the smallest id) of each class; all columns kept, documents without words too, and those
    with a null id, which are compared with nothing. Repeated rows of a kept id all stay."""
    name = fresh("copy")
    copies = jaccard_classes(docs, id_col, text_col, size, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(copies, F.col(id_col).cast("long") == F.col(name), "left_anti")
