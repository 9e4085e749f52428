"""Registered queries: cascades over excluded intervals, summaries of runs and masses, rank concordance, mixed samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import arrays as A
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import reports as R
from ..operators import stats as T
from . import fixtures as V
from .evidence import _GAP, _gap
from .registry import query, rounded

# --- cascade ---------------------------------------------------------------------------------------------------------

_OPEN, _SHUT = f"(SELECT * FROM {V.ACCESSIBLE} WHERE signal >= 20000)", f"(SELECT * FROM {V.ACCESSIBLE} WHERE signal < 4000)"
_MEETS = "EXISTS (SELECT 1 FROM {} x WHERE x.chrom = p.chrom AND p.start_bp < x.end_bp AND x.start_bp < p.end_bp)"


@query(f"SELECT reason, count(*) AS n, count(DISTINCT chrom) AS chroms FROM (SELECT chrom, CASE WHEN start_bp < 1000 OR end_bp > 19990000 THEN 'out_of_bounds' WHEN {_MEETS.format(_SHUT)} THEN 'blacklist' WHEN NOT {_MEETS.format(_OPEN)} THEN 'no_accessibility' ELSE 'retained' END AS reason FROM {V.peaks_sql()} p) GROUP BY reason")
def exclusion_cascade(spark, d):
    """First failing reason of every peak: bounds, overlap with an excluded interval, no overlap with an accessible one."""
    p, a = V.peaks(spark, d), V.accessible(spark, d)
    shut = I.overlapping(p, I.merge(a.where("signal < 4000").select("chrom", "start_bp", "end_bp"))).select("id", F.lit(True).alias("shut"))
    p = I.max_overlap_signal(p, a.where("signal >= 20000")).join(shut, "id", "left")
    reason = R.first_reason({"out_of_bounds": (F.col("start_bp") < 1000) | (F.col("end_bp") > 19_990_000), "blacklist": F.col("shut").isNotNull(), "no_accessibility": F.col("overlap_signal").isNull()})
    return p.select("chrom", F.coalesce(reason, F.lit("retained")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("chroms"))


# --- summaries -------------------------------------------------------------------------------------------------------


@query(f"SELECT fold_id, seed, model_id, count(*) AS n, round(avg(gap), 6) AS mean, round(median(gap), 9) AS median, round(avg(gap) FILTER (label = 1), 6) AS mean_positive, round(avg(CASE WHEN (p_forward >= 0.5) <> (p_rc >= 0.5) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS flips FROM {_GAP} GROUP BY ALL")
def run_gap_summary(spark, d):
    g = _gap(spark, d).groupBy("fold_id", "seed", "model_id")
    flips = ((F.col("p_forward") >= 0.5) != (F.col("p_rc") >= 0.5)).cast("double")
    return g.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("gap")).alias("mean"), rounded(F.median("gap"), 9).alias("median"), rounded(F.avg(F.when(F.col("label") == 1, F.col("gap")))).alias("mean_positive"), rounded(F.avg(flips)).alias("flips"))


_MASSES = f"(SELECT label, list_sum(list_transform(fwd[25:40], lambda z: abs(z))) / list_sum(list_transform(fwd, lambda z: abs(z))) AS core FROM {V.ATTRIBUTIONS} JOIN embeddings ON vec_id = sample_id)"


@query(f"SELECT label, count(*) AS n, round(avg(core), 6) AS core, count(*) FILTER (core > 0.25) AS enriched, round(avg(core) FILTER (core > 0.25), 6) AS core_if_enriched, round(avg(CASE WHEN core > 0.25 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM {_MASSES} GROUP BY label")
def mass_summary(spark, d):
    """Mass on the middle quarter, over all and over those that hold more than a quarter there."""
    labels = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    m = V.attributions(spark, d).select("sample_id", A.mass_fraction(F.col("fwd"), 24, 40).alias("core")).join(labels, "sample_id")
    on = F.col("core") > 0.25
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("core")).alias("core"), F.count_if(on).alias("enriched"), rounded(F.avg(F.when(on, F.col("core")))).alias("core_if_enriched"), rounded(F.avg(on.cast("double"))).alias("share"))


# --- concordance -----------------------------------------------------------------------------------------------------

_WIDE = f"(SELECT seed, sample_id, max(p_forward) FILTER (model_id = 0) AS a, max(p_forward) FILTER (model_id = 1) AS b FROM {V.PREDICTIONS} GROUP BY ALL)"
_RANK = "rank() OVER (PARTITION BY seed ORDER BY {0}) + (count(*) OVER (PARTITION BY seed, {0}) - 1) / 2.0"


@query(f"SELECT seed, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM (SELECT *, {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM {_WIDE}) GROUP BY seed")
def rank_concordance(spark, d):
    """Two models' predictions: Pearson, Spearman (average ranks) and cosine, per seed."""
    of = lambda m: F.max(F.when(F.col("model_id") == m, F.col("p_forward")))
    w = V.predictions(spark, d).groupBy("seed", "sample_id").agg(of(0).alias("a"), of(1).alias("b"))
    w = O.average_ranks(O.average_ranks(w, ["seed"], "a", "ra"), ["seed"], "b", "rb")
    a, b = F.col("a"), F.col("b")
    cosine = F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b)))
    return w.groupBy("seed").agg(rounded(T.guarded_pearson("a", "b")).alias("pearson"), rounded(T.guarded_pearson("ra", "rb")).alias("spearman"), rounded(cosine).alias("cosine"))


# --- samples ---------------------------------------------------------------------------------------------------------

_MEANS = f"(SELECT sample_id, label, round(avg((p_forward + p_rc) / 2), 6) AS mean_p FROM {V.PREDICTIONS} GROUP BY ALL)"


@query(f"(SELECT 'hard_negative' AS kind, sample_id FROM {_MEANS} WHERE label = 0 ORDER BY mean_p DESC, sample_id LIMIT 20) UNION ALL (SELECT 'random_positive', sample_id FROM {_MEANS} WHERE label = 1 ORDER BY sha256('17:' || sample_id), sample_id LIMIT 20)")
def mixed_examples(spark, d):
    """The negatives that score highest, and as many positives by a seeded rank."""
    m = V.predictions(spark, d).groupBy("sample_id", "label").agg(rounded(F.avg((F.col("p_forward") + F.col("p_rc")) / 2)).alias("mean_p"))
    hard = m.where("label = 0").orderBy(F.desc("mean_p"), "sample_id").limit(20)
    some = m.where("label = 1").orderBy(S.stable_rank(F.col("sample_id"), 17), "sample_id").limit(20)
    return hard.select(F.lit("hard_negative").alias("kind"), "sample_id").union(some.select(F.lit("random_positive").alias("kind"), "sample_id"))
