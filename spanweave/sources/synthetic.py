"""Labelled synthetic sequences. Every draw is a hash of (seed, split, number, what is drawn), so rows need no order, any retry
makes the same ones, and any engine with SHA-256 can. Half of a split is positive, spread by a fixed permutation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, revcomp
from ..operators.lineage import checkpointed

#: A negative sequence that holds the motif by accident is drawn again so often at most.
ATTEMPTS = 16


def uniform(key: Column, what: str) -> Column:
    """In [0, 1), from the first 48 bits of the hash."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(f":{what}")), 256), 1, 12), 16, 10).cast("double") / 2.0**48


def whole(key: Column, what: str, first: int | Column, last: int | Column) -> Column:
    """An integer of [first, last]."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return (first + F.floor(uniform(key, what) * (last - first + 1))).cast("int")


def background(key: Column, length: int, gc: float = 0.5) -> Column:
    """`length` letters, G or C with probability `gc`; sixteen letters a hash."""
    def letter(v: Column) -> Column:
        return F.when(v < gc * 65536, F.when(v % 2 == 0, "G").otherwise("C")).otherwise(F.when(v % 2 == 0, "A").otherwise("T"))

    def sixteen(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: letter(F.conv(F.substr(h, 4 * i + 1, F.lit(4)), 16, 10).cast("int")))

    hashes = F.transform(F.sequence(F.lit(0), F.lit((length - 1) // 16)), lambda j: F.sha2(F.concat(key, F.lit(":letters:"), j.cast("string")), 256))
    return F.substring(F.array_join(F.flatten(F.transform(hashes, sixteen)), ""), 1, length)


def planted(sequence: Column, instance: Column, start: Column) -> Column:
    return F.overlay(sequence, instance, start + 1)


def inexact(motif: str, key: Column, what: str, match: Column) -> Column:
    """The motif, each letter kept with probability `match`, else one of the three others."""
    def letter(i: int) -> Column:
        others = [b for b in "ACGT" if b != motif[i]]
        n = whole(key, f"{what}:other:{i}", 0, 2)
        return F.when(uniform(key, f"{what}:keep:{i}") < match, motif[i]).otherwise(F.when(n == 0, others[0]).when(n == 1, others[1]).otherwise(others[2]))

    return F.concat(*map(letter, range(len(motif))))


def _numbered(spark: SparkSession, sizes: dict[str, int], seed: int) -> DataFrame:
    """(split, i, sample_id, label, redraw) of every row to make."""
    def part(split: str, n: int) -> DataFrame:
        step = next(a for a in range(int(n * 0.618) + 1, 2 * n + 3) if math.gcd(a, n) == 1) if n else 1
        place = (F.col("id") * step + seed) % max(n, 1)
        return spark.range(n).select(F.lit(split).alias("split"), F.col("id").alias("i"), F.format_string(f"{split}_%06d", "id").alias("sample_id"), (place < n // 2).cast("int").alias("label"), F.lit(0).alias("redraw"))

    return reduce(DataFrame.union, (part(*x) for x in sizes.items()))


def _distinct(rows: DataFrame, draw, seed: int, rounds: int = 20) -> DataFrame:
    """`draw` of the rows, where those whose sequence, on either strand, an earlier row has are drawn again."""
    key = F.concat_ws(":", F.lit(str(seed)), "split", F.col("i").cast("string"), F.col("redraw").cast("string"))
    for _ in range(rounds):
        made = draw(rows.withColumn("key", key))
        again = F.row_number().over(Window.partitionBy(F.sha2(canonical(F.col("sequence")), 256)).orderBy("redraw", "split", "i")) > 1
        marked = made.select("*", again.alias("again"))
        if marked.where("again").isEmpty():
            return made.drop("key", "i")
        rows = checkpointed(marked.select("split", "i", "sample_id", "label", (F.col("redraw") + F.col("again").cast("int")).alias("redraw")))
    raise ValueError(f"sequences still repeat after {rounds} rounds: too few of that length")


def planted_motifs(spark: SparkSession, sizes: dict[str, int], motif: str, length: int, seed: int) -> DataFrame:
    """(split, sample_id, label, redraw, sequence, motif_start, motif_end, motif_orientation): positives hold the motif once, on a
    random strand and place; negatives hold it on neither strand. No sequence repeats on either strand."""
    back = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    clean = lambda s: ~(F.contains(s, F.lit(motif)) | F.contains(s, F.lit(back)))
    drawn = lambda a: background(F.concat(F.col("key"), F.lit(":"), a.cast("string")), length)

    def draw(rows: DataFrame) -> DataFrame:
        start = F.when(F.col("label") == 1, whole(F.col("key"), "start", 0, length - len(motif)))
        side = F.when(F.col("label") == 1, F.when(uniform(F.col("key"), "strand") < 0.5, "forward").otherwise("reverse_complement"))
        r = rows.select("*", drawn(F.lit(0)).alias("s"), start.alias("motif_start"), side.alias("motif_orientation"))
        later = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS - 1)), drawn), clean), 0)
        without = F.when(clean(F.col("s")), F.col("s")).otherwise(F.coalesce(later, F.raise_error(F.lit("the motif is in every draw"))))
        held = planted(F.col("s"), F.when(F.col("motif_orientation") == "forward", motif).otherwise(back), F.col("motif_start"))
        r = r.withColumn("sequence", F.when(F.col("label") == 1, held).otherwise(without)).withColumn("motif_end", F.col("motif_start") + len(motif))
        return r.select("split", "i", "sample_id", "label", "redraw", "key", "sequence", "motif_start", "motif_end", "motif_orientation")

    return _distinct(_numbered(spark, sizes, seed), draw, seed)


def motif_grammar(spark: SparkSession, sizes: dict[str, int], motifs: tuple[str, str], length: int, seed: int, gap: tuple[int, int] = (10, 24), wrong_gap: tuple[int, int] = (40, 64),
                  match: float = 1.0, gc: float = 0.5, noise: dict[str, float] | None = None) -> DataFrame:
    """(split, sample_id, label, redraw, sequence, clean_label, left_motif, left_start, left_end, right_start, right_end, gap): two
    motifs, the left one forward; in positives the right one is reversed and the gap lies in `gap`. Half of the negatives
    break the gap, half the orientation. The mirrored order stands for the other strand. `label` is `clean_label`, flipped
    with the split's share of `noise`."""
    a, b = motifs

    def draw(rows: DataFrame) -> DataFrame:
        k = F.col("key")
        far = (F.col("label") == 0) & (uniform(k, "wrong") < 0.5)
        r = rows.select("*", far.alias("far"), (uniform(k, "mirror") < 0.5).alias("ba"), inexact(a, k, "a", F.lit(match)).alias("ia"), inexact(b, k, "b", F.lit(match)).alias("ib"), background(k, length, gc).alias("s"))
        r = r.withColumn("gap", F.when(F.col("far"), whole(k, "gap", *wrong_gap)).otherwise(whole(k, "gap", *gap)))
        left, right = F.when(F.col("ba"), F.col("ib")).otherwise(F.col("ia")), F.when(F.col("ba"), F.col("ia")).otherwise(F.col("ib"))
        turned = (F.col("label") == 1) | F.col("far")
        r = r.select("*", left.alias("left"), F.when(turned, revcomp(right)).otherwise(right).alias("right"))
        r = r.withColumn("left_start", whole(k, "start", 0, length - len(a) - len(b) - F.col("gap")))
        r = r.withColumn("left_end", F.col("left_start") + F.length("left")).withColumn("right_start", F.col("left_end") + F.col("gap"))
        r = r.withColumn("right_end", F.col("right_start") + F.length("right"))
        sequence = planted(planted(F.col("s"), F.col("left"), F.col("left_start")), F.col("right"), F.col("right_start"))
        return r.select("split", "i", "sample_id", "label", "redraw", "key", sequence.alias("sequence"), F.when(F.col("ba"), "B").otherwise("A").alias("left_motif"), "left_start", "left_end", "right_start", "right_end", "gap")

    made = _distinct(_numbered(spark, sizes, seed), draw, seed)
    share = F.lit(0.0)
    for split, p in (noise or {}).items():
        share = F.when(F.col("split") == split, p).otherwise(share)
    flipped = uniform(F.concat_ws(":", F.lit(str(seed)), "sample_id"), "noise") < share
    return made.withColumn("clean_label", F.col("label")).withColumn("label", F.when(flipped, 1 - F.col("label")).otherwise(F.col("label")))
