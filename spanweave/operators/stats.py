"""Ranking metrics, balance tests, correlations, false discovery control, resampling. Nulls stand for undefined values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O
from . import resample as B


def thresholds(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Cumulative true and false positives at each distinct threshold; rows without a label count as neither."""
    t = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1.0 - F.col(label)).alias("q"))
    return cumulated(t, by, score)


def cumulated(t: DataFrame, by: list[str], score: str) -> DataFrame:
    """`t`, which counts positives p and negatives q per group and score, with those at or above the score and in all."""
    t = O.sums_below(t, by, score, ["p", "q"])
    return t.select(*by, score, (F.col("p_total") - F.col("p_below")).alias("tp"), (F.col("q_total") - F.col("q_below")).alias("fp"), F.col("p_total").alias("pos"), F.col("q_total").alias("neg"), "p", "q")


def auroc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Share of pairs of a positive and a negative row in which the positive scores higher, ties as a half."""
    t = thresholds(df, by, label, score)
    won = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("q") / 2))
    return t.groupBy(*by).agg(F.try_divide(won, F.max("pos") * F.max("neg")).alias("auroc"))


def auprc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    t = thresholds(df, by, label, score)
    return t.groupBy(*by).agg(F.sum(F.expr("try_divide(p, pos) * tp / (tp + fp)")).alias("auprc"))


def roc_points(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    return thresholds(df, by, label, score).select(*by, score, F.expr("try_divide(tp, pos)").alias("tpr"), F.expr("try_divide(fp, neg)").alias("fpr"))


def roc_area(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve by trapezoids; groups without both labels have no row."""
    t = thresholds(df, by, label, score).where("pos > 0 and neg > 0")
    step = F.col("q") / F.col("neg") * (2 * F.col("tp") - F.col("p")) / F.col("pos") / 2
    return t.groupBy(*by).agg(F.sum(step).alias("area"))


def roc_band(df: DataFrame, by: list[str], repeat: str, label: str, score: str, steps: int = 500) -> DataFrame:
    """(by, point, mean, low, high): curves of all repeats, interpolated at `steps` + 1 even false positive rates, from 0 at the
    first to 1 at the last; their mean with one sample deviation either way, within 0 and 1. One repeat has no
    deviation. Each stretch between two thresholds yields the points that lie on it; where the curve rises upright, a
    point takes the upper end."""
    t = thresholds(df, [*by, repeat], label, score).where("pos > 0 and neg > 0 and p + q > 0")
    x0, x1 = (F.col("fp") - F.col("q")) / F.col("neg"), F.col("fp") / F.col("neg")
    y0, y1 = (F.col("tp") - F.col("p")) / F.col("pos"), F.col("tp") / F.col("pos")
    last = ((F.col("fp") == F.col("neg")) & (F.col("tp") == F.col("pos"))).cast("int")
    first, end = F.ceil(steps * x0).cast("int"), F.ceil(steps * x1).cast("int") - 1 + last
    s = t.select(*by, repeat, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), first.alias("first"), end.alias("end")).where("end >= first")
    s = s.select("*", F.explode(F.sequence("first", "end")).alias("point"))
    on = F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(F.col("point") / steps - F.col("x0"), F.col("x1") - F.col("x0"))
    y = F.when(F.col("point") == 0, 0.0).when(F.col("point") == steps, 1.0).otherwise(on)
    g = s.groupBy(*by, "point").agg(F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("sd"))
    side = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return g.select(*by, "point", "mean", side(F.col("mean") - F.col("sd")).alias("low"), side(F.col("mean") + F.col("sd")).alias("high"))


def threshold_metrics(df: DataFrame, by: list[str], label: str, score: str, at: float = 0.5) -> DataFrame:
    hit = F.col(score) >= at
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    c = df.groupBy(*by).agg(n(hit & (F.col(label) == 1)).alias("tp"), n(hit & (F.col(label) == 0)).alias("fp"), n(~hit & (F.col(label) == 1)).alias("fn"), n(~hit & (F.col(label) == 0)).alias("tn"))
    return c.select(*by, ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), F.expr("coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0.0)").alias("f1"))


def log_loss(logit: Column, label: Column) -> Column:
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))


def similarity(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson, Spearman and cosine per group; null where a side is constant or zero."""
    r = O.average_ranks(O.average_ranks(df.select(*by, a, b), by, a, "_ra"), by, b, "_rb")
    pearson = lambda x, y: F.try_divide(F.covar_pop(x, y), F.when(F.stddev_pop(x) * F.stddev_pop(y) > 1e-300, F.stddev_pop(x) * F.stddev_pop(y)))
    cosine = F.try_divide(F.sum(F.col(a) * F.col(b)), F.when(F.sum(F.col(a) ** 2) * F.sum(F.col(b) ** 2) > 0, F.sqrt(F.sum(F.col(a) ** 2)) * F.sqrt(F.sum(F.col(b) ** 2))))
    return r.groupBy(*by).agg(pearson(a, b).alias("pearson"), pearson("_ra", "_rb").alias("spearman"), cosine.alias("cosine"))


def guarded_pearson(a: str, b: str) -> Column:
    """Aggregate: correlation by moments; null where a side is constant or there are fewer than two rows."""
    x, y = F.col(a), F.col(b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def mean_difference(df: DataFrame, label: str, value: str) -> DataFrame:
    """Standardised mean difference between label 1 and 0 with the mean of both sample variances."""
    side = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    s = df.agg(side(F.avg, 1).alias("m1"), side(F.avg, 0).alias("m0"), side(F.var_samp, 1).alias("v1"), side(F.var_samp, 0).alias("v0"))
    return s.select(F.expr("coalesce(try_divide(m1 - m0, sqrt((v1 + v0) / 2)), 0.0)").alias("smd"))


def kolmogorov_smirnov(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """ks, the largest distance between the two empirical distributions, and its asymptotic two-sided p; both null where a side
    is empty."""
    by = by or []
    t = thresholds(df, by, label, value)
    d = t.groupBy(*by).agg(F.max(F.abs(F.expr("try_divide(tp, pos) - try_divide(fp, neg)"))).alias("ks"), F.max(F.expr("try_divide(pos * neg, pos + neg)")).alias("n"))
    x = F.col("n") * F.col("ks") * F.col("ks")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x))
    tail = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    p = F.when(x < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))  # below, p is 1 to ten digits
    return d.select(*by, "ks", F.when(F.col("ks").isNotNull(), p).alias("p"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, n = F.try_divide(k.cast("double"), n), n.cast("double")
    centre, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, missing_as_one: bool = False) -> DataFrame:
    """`df` with q; equal p have equal q. Null p stays null, or counts as 1."""
    v = F.coalesce(p, F.lit(1.0)) if missing_as_one else F.col(p)
    marked = df.withColumn("_v", v)
    t = marked.where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    t = O.sums_below(t, by, "_v", ["_n"]).withColumn("_q", F.col("_v") * F.col("_n_total") / (F.col("_n_below") + F.col("_n")))
    q = O.least_from(t, by, "_v", "_q").select(*by, "_v", F.least(F.lit(1.0), "_q_least").alias("q"))
    return O.join_same(marked, q, [*by, "_v"], "left").drop("_v")


def bootstrap_mean(df: DataFrame, by: list[str], value: str, order: str, replicates: int) -> DataFrame:
    """Mean, 2.5 and 97.5 % percentiles of the means of resampled rows; nulls and NaN are dropped."""
    v = df.select(*by, F.col(order).alias("o"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ci = B.replicate_means(v, by, [], replicates).groupBy(*by).agg(F.expr("percentile(x, array(0.025, 0.975))").alias("ci"))
    return v.groupBy(*by).agg(F.avg("x").alias("mean")).join(ci, by).select(*by, "mean", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def signed_rank(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Wilcoxon's W+ over non-zero differences and its normal z (ties averaged)."""
    x = F.col(difference)
    t = df.where(x != 0).groupBy(*by, F.abs(x).alias("_a")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((x > 0).cast("double")).alias("up"))
    t = O.sums_below(t, by, "_a", ["n"])
    s = t.groupBy(*by).agg(F.sum(F.col("up") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("w_plus"), F.sum("n").alias("n"))
    return s.select(*by, "w_plus", F.expr("try_divide(w_plus - n * (n + 1) / 4, sqrt(n * (n + 1) * (2 * n + 1) / 24))").alias("z"))


#: Groups of up to so many differences get the exact null distribution.
EXACT = 50


def _tail(ranks: list[int] | None, w: float, n: float, ties: float, greater: bool) -> float:
    """P(W+ >= w), or <= w, under random signs. `ranks`: doubled average ranks, for the exact distribution: the number of sign
    choices per sum, added rank by rank. None: the normal tail with the variance that ties leave."""
    if ranks is None:
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        return 0.5 * math.erfc((z if greater else -z) / math.sqrt(2))
    ways = np.zeros(int(sum(ranks)) + 1)
    ways[0] = 1.0
    for r in ranks:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    at = round(2 * w)
    return float((ways[at:] if greater else ways[: at + 1]).sum() / 2.0 ** len(ranks))


def signed_rank_test(df: DataFrame, by: list[str], difference: str, alternative: str = "greater") -> DataFrame:
    """by, n, w_plus, p: Wilcoxon's one-sided signed-rank test of paired differences. Null and NaN differences are dropped; zeros
    are not ranked, ties get average ranks. p is exact for up to EXACT ranked differences (ties included), else normal
    without continuity correction; null where fewer than two differences are there or all are zero."""
    if alternative not in ("greater", "less"):
        raise ValueError("alternative is greater or less")
    x = F.col(difference).cast("double")
    rows = df.select(*by, x.alias("_x")).where("_x is not null and not isnan(_x)")
    every = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_held"))
    t = rows.where("_x <> 0").groupBy(*by, F.abs("_x").alias("_a")).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum((F.col("_x") > 0).cast("double")).alias("_up"))
    t = O.sums_below(t, by, "_a", ["_n"]).withColumn("_rank", F.col("_n_below") + (F.col("_n") + 1) / 2)
    s = t.groupBy(*by).agg(F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum("_n").alias("n"), F.sum(F.col("_n") ** 3 - F.col("_n")).alias("_ties"))
    small = O.join_same(t, s.where(F.col("n") <= EXACT).select(*by), by, "left_semi") if by else t.join(s.where(F.col("n") <= EXACT).select("n"), how="left_semi")
    lists = small.groupBy(*by).agg(F.flatten(F.collect_list(F.expr("array_repeat(cast(2 * _rank as int), cast(_n as int))"))).alias("_ranks"))

    @F.pandas_udf("double")
    def p_value(ranks: pd.Series, w: pd.Series, n: pd.Series, ties: pd.Series, held: pd.Series) -> pd.Series:
        rows = zip(ranks, w, n, ties, held, strict=True)
        return pd.Series([_tail(None if r is None else list(r), a, b, c, alternative == "greater") if h >= 2 and b == b and b else None for r, a, b, c, h in rows], dtype="float64")

    out = O.join_same(O.join_same(every, s, by, "left"), lists, by, "left")
    return out.select(*by, F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), p_value("_ranks", "w_plus", "n", "_ties", "_held").alias("p"))
