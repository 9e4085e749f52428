"""Equivalence of two references, component by component, by trees of chunk digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node of the digest tree.
FAN = 1024


def _digested(chunks: DataFrame) -> DataFrame:
    """(component, level 0 node, digest, letters) per chunk; chunks: component, chunk, seq."""
    return chunks.select("component", F.col("chunk").alias("node"), F.sha2(F.upper("seq"), 256).alias("digest"), F.length("seq").cast("long").alias("letters"))


def roots(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(component, digest, letters): digests of up to `fan` neighbouring nodes are digested again, level by level, until a
    component is one node; no group holds more than `fan` digests, whatever a component's length."""
    level = _digested(chunks)
    most = chunks.agg(F.max("chunk")).first()[0] or 0
    while True:
        parts = level.groupBy("component", F.floor(F.col("node") / fan).alias("node"))
        level = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), "\n"), 256).alias("digest"), F.sum("letters").alias("letters"))
        most //= fan
        if not most:
            return level.select("component", "digest", "letters")


def audit_components(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """(component, left_letters, right_letters, verdict): `same`, `length`, `letters`, `left only` or `right only`."""
    a, b = (roots(x, fan).select("component", F.col("digest").alias(f"{s}_digest"), F.col("letters").alias(f"{s}_letters")) for x, s in ((left, "left"), (right, "right")))
    verdict = (
        F.when(F.col("right_digest").isNull(), "left only").when(F.col("left_digest").isNull(), "right only").when(F.col("left_digest") == F.col("right_digest"), "same")
        .when(F.col("left_letters") != F.col("right_letters"), "length").otherwise("letters")
    )
    return a.join(b, "component", "full").select("component", "left_letters", "right_letters", verdict.alias("verdict"))


def differing_chunks(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """(component, chunk, first_difference, differing): chunks of components that both sides hold and that are not the same; the
    first differing place in the chunk and how many places differ (a place that only one side has differs). Only digests of
    such components are compared, and letters are read only of chunks whose digests differ."""
    odd = audit_components(left, right, fan).where("verdict in ('length', 'letters')").select("component")
    of = lambda x: _digested(x.join(odd, "component", "left_semi")).select("component", F.col("node").alias("chunk"), "digest")
    a, b = of(left).withColumnRenamed("digest", "x"), of(right).withColumnRenamed("digest", "y")
    wanted = a.join(b, ["component", "chunk"], "full").where("not (x <=> y)").select("component", "chunk")
    letters = lambda x, name: x.select("component", "chunk", F.upper("seq").alias(name))
    both = wanted.join(letters(left, "a"), ["component", "chunk"], "left").join(letters(right, "b"), ["component", "chunk"], "left")
    x, y = (F.split(F.coalesce(c, F.lit("")), "") for c in ("a", "b"))
    marks = F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), False).otherwise(True))  # the shorter side is filled with nulls
    apart: Column = F.filter(F.transform(marks, lambda m, i: F.when(m, i + 1)), lambda i: i.isNotNull())
    return both.withColumn("d", apart).select("component", "chunk", (F.col("d")[0] - 1).cast("long").alias("first_difference"), F.size("d").cast("long").alias("differing"))
