"""Relational reporting: descriptions, contrasts, grids, decisions, gates, and contracts on joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Long table: n, mean, sd, median, q25, q75, p95 of each value per group."""
    long = df.unpivot(by, values, "metric", "value").where(F.col("value").isNotNull())
    q = F.expr("percentile(value, array(0.25, 0.5, 0.75, 0.95))")
    d = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return d.select(*by, "metric", "n", "mean", "sd", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), F.col("q")[3].alias("p95"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails while running if a key repeats on either side."""
    once = lambda df: df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("key is not unique"))).where("_ok is null").drop("_n", "_ok")
    return once(left).join(once(right), keys, how)


def contrast(df: DataFrame, keys: list[str], column: str, value: str, earlier, later) -> DataFrame:
    """later - earlier of `value` for each key that has both."""
    side = lambda v, name: df.where(F.col(column) == v).select(*keys, F.col(value).alias(name))
    return side(later, "_l").join(side(earlier, "_e"), keys).select(*keys, (F.col("_l") - F.col("_e")).alias("difference"))


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first failing test, null if none fails."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(reasons.items()):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row (gate, passed) per aggregate check."""
    row = df.agg(*(c.alias(k) for k, c in checks.items()))
    return row.unpivot([], list(checks), "gate", "passed")


def decision(low: Column, high: Column, bound: float) -> Column:
    return F.when(low.isNull() | high.isNull(), "not_estimable").when(low > bound, "supported").when(high < bound, "contradicted").otherwise("inconclusive")


def missing_combinations(seen: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Parameter combinations that `seen` lacks; the dimensions are short literal lists."""
    spark = seen.sparkSession
    grid = None
    for name, values in dims.items():
        d = spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
        grid = d if grid is None else grid.join(F.broadcast(d), F.lit(True))
    return grid.exceptAll(seen.select(*dims).distinct())
