"""Column functions on DNA strings and coordinates; all stay in whole-stage code generation or array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_dna(s: Column) -> Column:
    return F.coalesce(s.rlike("^[ACGTacgt]+$"), F.lit(False))


def checked_dna(s: Column) -> Column:
    """Upper-cased sequence; an error for null and empty strings and for other letters, which it lists."""
    bad = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(s), F.lit("[^ACGT]"), F.lit(0)))), "")
    said = F.when(s.isNull(), "null").when(s == "", "empty").otherwise(F.concat(F.lit("letters "), bad))
    return F.when(is_dna(s), F.upper(s)).otherwise(F.raise_error(F.concat(F.lit("not a DNA sequence: "), said)))


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(F.upper(s), "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The same key for a sequence and its reverse complement."""
    return F.least(F.upper(s), revcomp(s))


def canonical_sha256(s: Column) -> Column:
    return F.sha2(canonical(s), 256)


def gc_fraction(s: Column) -> Column:
    return (F.length(s) - F.length(F.translate(F.upper(s), "GC", ""))) / F.length(s)


def gc_bin(s: Column, width: float = 0.02) -> Column:
    return F.least(F.lit(int(1 / width) - 1), F.floor(gc_fraction(s) / F.lit(width))).cast("int")


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over A, C, G, T."""
    total = F.lit(0.0)
    for base in "ACGT":
        p = (F.length(s) - F.length(F.translate(s, base, ""))) / F.length(s)
        total = total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return total


def longest_run(s: Column) -> Column:
    """Length of the longest homopolymer."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("A+|C+|G+|T+"), 0), F.length)), F.lit(0))


def low_complexity(s: Column) -> Column:
    return (entropy(s) < 1.2) | (longest_run(s) >= 12)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; an error for sequences of different lengths, null if one is null."""
    differ = F.size(F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: x != y), lambda x: x)).cast("int")
    unequal = F.raise_error(F.concat(F.lit("Hamming distance of lengths "), F.length(a).cast("string"), F.lit(" and "), F.length(b).cast("string")))
    return F.when(F.length(a) == F.length(b), differ).when(a.isNotNull() & b.isNotNull(), unequal)


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order; none if the sequence is shorter than k."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1)))
    return F.when(F.length(s) >= k, F.transform(starts, lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical_kmers(s: Column, k: int) -> Column:
    """Distinct strand-free k-mers."""
    return F.array_distinct(F.transform(kmers(s, k), canonical))


def one_hot(s: Column) -> Column:
    """One array of A, C, G, T indicators per position."""
    return F.transform(F.split(F.upper(s), ""), lambda b: F.array(*((b == x).cast("int") for x in "ACGT")))


def window(summit: Column, length: int = 256) -> tuple[Column, Column]:
    return summit - length // 2, summit - length // 2 + length


def region(chrom: Column, start: Column, end: Column) -> Column:
    """One-based inclusive chrom:start..end:1."""
    return F.concat(chrom, F.lit(":"), (start + 1).cast("string"), F.lit(".."), end.cast("string"), F.lit(":1"))


def stable_rank(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def digest(salt: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), *(k.cast("string") for k in keys)), 256)


def matched_flank_start(length: int, start: Column, width: int) -> Column:
    """Struct (gap, start): nearest start to the mirrored position whose window does not overlap the motif; ties to the lower start."""
    mirror = F.lit(length - width) - start
    free = F.filter(F.sequence(F.lit(0), F.lit(length - width)), lambda s: (s + width <= start) | (s >= start + width))
    return F.array_min(F.transform(free, lambda s: F.struct(F.abs(s - mirror).alias("gap"), s.alias("start"))))


def shifted_bases(s: Column) -> Column:
    """Every base replaced by the next one: A to C to G to T to A."""
    return F.translate(s, "ACGT", "CGTA")


def overlay_at(s: Column, item: Column, start: Column) -> Column:
    return F.overlay(s, item, start + 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
