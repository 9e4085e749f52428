"""Interval algebra on 0-based half-open intervals (chrom, start_bp, end_bp).

Overlap joins explode both sides into bins of fixed width and join on (chrom, bin); a pair is kept only in its first
common bin, so no distinct is needed. Rows in proportion to interval length / width, then to the pairs found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import join_same

WIDTH = 1024


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.where("end_bp > start_bp").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_bp") / width), F.floor((F.col("end_bp") - 1) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keep_left: list[str], keep_right: list[str], width: int = WIDTH) -> DataFrame:
    """Every overlapping pair with `overlap_bp`. Columns are prefixed l_ and r_. Empty intervals meet nothing."""
    l = _binned(left, width).select("chrom", "_bin", F.col("start_bp").alias("_ls"), F.col("end_bp").alias("_le"), *(F.col(c).alias(f"l_{c}") for c in keep_left))  # noqa: E741
    r = _binned(right, width).select("chrom", "_bin", F.col("start_bp").alias("_rs"), F.col("end_bp").alias("_re"), *(F.col(c).alias(f"r_{c}") for c in keep_right))
    both = l.join(r, ["chrom", "_bin"]).where((F.col("_ls") < F.col("_re")) & (F.col("_rs") < F.col("_le")) & (F.col("_bin") == F.floor(F.greatest("_ls", "_rs") / width)))
    return both.withColumn("overlap_bp", F.least("_le", "_re") - F.greatest("_ls", "_rs")).drop("_bin", "_ls", "_le", "_rs", "_re")


def overlapping(left: DataFrame, right: DataFrame, id_col: str = "id", anti: bool = False, width: int = WIDTH) -> DataFrame:
    """Rows of `left` that overlap (or, `anti`, do not overlap) any of `right`."""
    hits = overlap_join(left, right, [id_col], [], width).select(F.col(f"l_{id_col}").alias(id_col)).distinct()
    return left.join(hits, id_col, "left_anti" if anti else "left_semi")


def max_overlap_signal(left: DataFrame, right: DataFrame, id_col: str = "id", signal: str = "signal", width: int = WIDTH) -> DataFrame:
    """`left` with `overlap_signal`, the largest signal among overlapping `right`; null if there is none."""
    best = overlap_join(left, right, [id_col], [signal], width).groupBy(F.col(f"l_{id_col}").alias(id_col)).agg(F.max(f"r_{signal}").alias("overlap_signal"))
    return left.join(best, id_col, "left")


#: Islands are found in stretches of a chromosome that hold at most so many different starts.
STRETCH = 1 << 16


def islands(df: DataFrame, by: str = "chrom", touching: bool = True) -> DataFrame:
    """(by, start_bp, end_bp, island): every different start with its farthest end and the start of the island, a chain of
    overlapping (or, `touching`, adjoining) intervals, that it lies on. Intervals with null bounds lie on none.

    Starts are made distinct on the map side, so a stretch is a bounded window whatever its rows. The reach of earlier
    stretches, and the island still open there, come from a table of one row per stretch.
    """
    t = df.where("start_bp is not null and end_bp is not null").groupBy(by, "start_bp").agg(F.max("end_bp").alias("end_bp"))
    t = t.withColumn("_at", F.floor(F.col("start_bp") / STRETCH))
    order = Window.partitionBy(by, "_at").orderBy("start_bp")
    apart = (lambda reach: F.col("start_bp") > reach) if touching else (lambda reach: F.col("start_bp") >= reach)
    reach = F.max("end_bp").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(apart(reach) | reach.isNull(), F.col("start_bp"))
    inner = t.withColumn("_opens", opens).withColumn("_inner", F.last("_opens", ignorenulls=True).over(order))

    before = Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per = inner.groupBy(by, "_at").agg(F.max("end_bp").alias("_end"), F.max("_opens").alias("start_bp")).withColumn("_reach", F.max("_end").over(before))
    fresh = F.when(apart(F.col("_reach")) | F.col("_reach").isNull(), F.col("start_bp"))
    per = per.withColumn("_fresh", fresh).select(by, "_at", "_reach", F.last("_fresh", ignorenulls=True).over(before).alias("_open"))

    both = join_same(inner.withColumnRenamed("start_bp", "_start").withColumnRenamed("_inner", "start_bp"), per, [by, "_at"])
    own = F.when(apart(F.col("_reach")) | F.col("_reach").isNull(), F.col("start_bp")).otherwise(F.col("_open"))
    return both.select(by, F.col("_start").alias("start_bp"), "end_bp", own.alias("island"))


def merge(df: DataFrame, by: str = "chrom") -> DataFrame:
    """Union of overlapping or touching intervals per chromosome; intervals with null bounds are left out."""
    return islands(df, by).groupBy(by, F.col("island").alias("start_bp")).agg(F.max("end_bp").alias("end_bp"))


def buffered(df: DataFrame, margin: int = 128) -> DataFrame:
    return df.withColumn("start_bp", F.greatest(F.lit(0), F.col("start_bp") - margin)).withColumn("end_bp", F.col("end_bp") + margin)


def greedy_nonoverlap(df: DataFrame, priority: list[str], id_col: str = "id") -> DataFrame:
    """(id, kept): by falling `priority`, then id, a window is kept if it overlaps none kept before.

    Overlap never crosses a gap between merged intervals, so each island is decided by itself: groups are islands of
    overlapping windows, not chromosomes. Windows with null bounds have no row.
    """
    at = islands(df, touching=False).select("chrom", "start_bp", F.col("island").alias("_island"))
    placed = join_same(df, at, ["chrom", "start_bp"]).where("end_bp is not null")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        import bisect

        g = g.sort_values([*priority, id_col], ascending=[False] * len(priority) + [True])
        starts, ends, kept = [], [], []
        for s, e in zip(g["start_bp"], g["end_bp"], strict=True):
            at = bisect.bisect_left(starts, s)
            free = (at == 0 or ends[at - 1] <= s) and (at == len(starts) or starts[at] >= e)
            if free:
                starts.insert(at, s)
                ends.insert(at, e)
            kept.append(free)
        return pd.DataFrame({id_col: g[id_col], "kept": kept})

    kind = dict(df.dtypes)[id_col]
    sized = placed.groupBy("chrom", "_island").agg(F.count(F.lit(1)).alias("_size"))
    placed = join_same(placed, sized, ["chrom", "_island"])
    alone = placed.where("_size = 1").select(id_col, F.lit(True).alias("kept"))
    shared = placed.where("_size > 1").select("chrom", "_island", id_col, "start_bp", "end_bp", *priority)
    return alone.union(shared.groupBy("chrom", "_island").applyInPandas(pick, f"{id_col} {kind}, kept boolean"))
