"""Running sums, least values and ranks over the order of a value within groups, without one task per group.

Values fall into buckets that keep their order and depend on the value alone, so a lost executor changes nothing. What
precedes a row in its bucket comes from a window over (group, bucket), what precedes the bucket from a table of one row
per bucket. Equal values are summed first (on the map side), so a frequent value is one row. Nulls count as the least
value, NaN as the greatest; rows of a null group form a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FAR = 1 << 40


def bucket(value: Column) -> Column:
    """A long that never falls while the value rises: sign, binary exponent and the first ten digits after it."""
    x = value.cast("double")
    m = F.abs(x)
    e = F.floor(F.log2(m))
    step = F.when(m == 0, F.lit(0)).when(m > 1.7e308, F.lit(_FAR)).otherwise((e + 1100) * 4096 + F.floor(m / F.pow(F.lit(2.0), e) * 1024))
    return F.when(x.isNull(), F.lit(-_FAR - 1)).when(F.isnan(x), F.lit(_FAR + 1)).when(x < 0, -step).otherwise(step)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys of `left` stay."""
    r = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(r[f"_right_{k}"]) for k in keys))
    return left.join(r, on, how).drop(*(f"_right_{k}" for k in keys))


def sums_below(t: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """`t`, which has one row per group and value, with c_below and c_total for every column c: its sum over smaller values of
    the group, and over the whole group."""
    b = t.withColumn("_bucket", bucket(F.col(value)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = b.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = b.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(c) for c in columns))
    per = per.select(*by, "_bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_out_{c}") for c in columns), *(F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_total") for c in columns))
    both = join_same(rows, per, [*by, "_bucket"])
    return both.select(*t.columns, *((F.col(f"_in_{c}") + F.col(f"_out_{c}")).alias(f"{c}_below") for c in columns), *(f"{c}_total" for c in columns))


def least_from(t: DataFrame, by: list[str], value: str, column: str) -> DataFrame:
    """`t`, which has one row per group and value, with the least of `column` over this and greater values as column_least."""
    b = t.withColumn("_bucket", bucket(F.col(value)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    per = b.groupBy(*by, "_bucket").agg(F.min(column).alias("_m")).select(*by, "_bucket", F.min("_m").over(after).alias("_after"))
    both = join_same(b.withColumn("_in", F.min(column).over(inside)), per, [*by, "_bucket"])
    return both.select(*t.columns, F.least("_in", "_after").alias(f"{column}_least"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, size: str | None = None) -> DataFrame:
    """`df` with the rank of the value in its group, ties averaged, as `name`, and the group's rows as `size`."""
    t = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    r = sums_below(t, by, value, ["_n"])
    r = r.select(*by, value, (F.col("_n_below") + (F.col("_n") + 1) / 2).alias(name), *([F.col("_n_total").alias(size)] if size else []))
    return join_same(df, r, [*by, value])
