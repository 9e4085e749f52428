"""Registered queries on predictions and attributions: bootstraps, contrasts, concordance, rules and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import resample as B
from ..operators import stats as T
from . import fixtures as V
from .registry import query, rounded

_GAP = f"(SELECT fold_id, model_id, seed, sample_id, label, p_forward, p_rc, round(abs(p_forward - p_rc), 9) AS gap FROM {V.PREDICTIONS})"


def _gap(spark, d):
    return V.predictions(spark, d).withColumn("gap", F.round(F.abs(F.col("p_forward") - F.col("p_rc")), 9))


def _shown(b):
    return b.select(*(rounded(c).alias(c) if c in ("estimate", "low", "high", "p_corrected") else c for c in b.columns))


# --- bootstraps ------------------------------------------------------------------------------------------------------

_LESS = f"(SELECT a.fold_id, b.model_id, a.seed, a.sample_id, round(b.gap - a.gap, 9) AS x FROM {_GAP} a JOIN {_GAP} b ON a.sample_id = b.sample_id AND a.seed = b.seed AND a.model_id = 0 AND b.model_id > 0)"


def _less(spark, d):
    """Each model's gap less that of model 0, paired by seed and sample."""
    g = _gap(spark, d)
    a = g.where("model_id = 0").select("seed", "sample_id", F.col("gap").alias("own"))
    return g.where("model_id > 0").join(a, ["seed", "sample_id"]).select("fold_id", "model_id", "seed", "sample_id", F.round(F.col("gap") - F.col("own"), 9).alias("x"))


@query(B.bootstrap_sql(f"(SELECT model_id, seed, 1000000 * seed + sample_id AS o, round(p_forward - p_rc, 9) AS x FROM {V.PREDICTIONS})", ["model_id"], [], "o", "x", 40))
def paired_bootstrap(spark, d):
    p = V.predictions(spark, d).select("model_id", (1_000_000 * F.col("seed") + F.col("sample_id")).alias("o"), F.round(F.col("p_forward") - F.col("p_rc"), 9).alias("x"))
    return _shown(B.hierarchical_bootstrap(p, ["model_id"], [], "o", "x", 40))


@query(B.bootstrap_sql(_GAP, ["model_id"], ["seed"], "sample_id", "gap", 40))
def two_level_bootstrap(spark, d):
    return _shown(B.hierarchical_bootstrap(_gap(spark, d), ["model_id"], ["seed"], "sample_id", "gap", 40))


@query(B.bootstrap_sql(_LESS, ["model_id"], ["seed"], "sample_id", "x", 40))
def two_level_paired_bootstrap(spark, d):
    return _shown(B.hierarchical_bootstrap(_less(spark, d), ["model_id"], ["seed"], "sample_id", "x", 40))


@query(B.bootstrap_sql(_LESS, ["model_id"], ["fold_id", "seed"], "sample_id", "x", 40))
def three_level_paired_bootstrap(spark, d):
    return _shown(B.hierarchical_bootstrap(_less(spark, d), ["model_id"], ["fold_id", "seed"], "sample_id", "x", 40))


@query(B.bootstrap_sql(f"(SELECT *, CASE WHEN sample_id % 7 = 0 THEN 'nan'::DOUBLE WHEN sample_id % 5 = 0 THEN NULL ELSE gap END AS x FROM {_GAP})", ["model_id", "label"], ["fold_id", "seed"], "sample_id", "x", 40))
def bootstrap_of_incomplete(spark, d):
    x = F.when(F.col("sample_id") % 7 == 0, F.lit(float("nan"))).when(F.col("sample_id") % 5 != 0, F.col("gap"))
    return _shown(B.hierarchical_bootstrap(_gap(spark, d).withColumn("x", x), ["model_id", "label"], ["fold_id", "seed"], "sample_id", "x", 40))


_EFFECTS = f"(SELECT model_id, 10 * fold_id + seed AS cluster, round(avg(x), 9) AS x FROM {_LESS} GROUP BY ALL)"


@query(B.bootstrap_sql(_EFFECTS, ["model_id"], [], "cluster", "x", 200))
def cluster_bootstrap(spark, d):
    e = _less(spark, d).groupBy("model_id", (10 * F.col("fold_id") + F.col("seed")).alias("cluster")).agg(F.round(F.avg("x"), 9).alias("x"))
    return _shown(B.hierarchical_bootstrap(e, ["model_id"], [], "cluster", "x", 200))


# The three levels at the number of replicates that a confirmatory analysis states.
@query(B.bootstrap_sql(_LESS, ["model_id"], ["fold_id", "seed"], "sample_id", "x", 10_000))
def confirmatory_bootstrap(spark, d):
    return _shown(B.hierarchical_bootstrap(_less(spark, d), ["model_id"], ["fold_id", "seed"], "sample_id", "x", 10_000))


# --- concordance, rules ----------------------------------------------------------------------------------------------

_CORR = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN round(corr({0}, {1}), 6) END"


@query(f"WITH w AS (SELECT seed, sample_id, max(p_forward) FILTER (WHERE model_id = 0) AS m0, max(p_forward) FILTER (WHERE model_id = 1) AS m1, max(p_forward) FILTER (WHERE model_id = 2) AS m2 FROM {V.PREDICTIONS} GROUP BY ALL) "
       f"SELECT seed, 1 AS other, {_CORR.format('m0', 'm1')} AS pearson FROM w GROUP BY seed UNION ALL SELECT seed, 2, {_CORR.format('m0', 'm2')} FROM w GROUP BY seed")
def method_concordance(spark, d):
    w = V.predictions(spark, d).groupBy("seed", "sample_id").pivot("model_id", [0, 1, 2]).agg(F.max("p_forward"))
    x = w.select("seed", F.explode(F.array(*(F.struct(F.lit(m).alias("other"), F.col("0").alias("a"), F.col(str(m)).alias("b")) for m in (1, 2)))).alias("c")).select("seed", "c.*")
    return x.groupBy("seed", "other").agg(rounded(T.guarded_pearson("a", "b")).alias("pearson"))


@query(f"WITH p AS (SELECT model_id, CAST(seed AS VARCHAR) AS scope, p_forward, gap FROM {_GAP} UNION ALL SELECT model_id, 'all', p_forward, gap FROM {_GAP}) SELECT model_id, scope, count(*) AS n, {_CORR.format('p_forward', 'gap')} AS pearson FROM p GROUP BY ALL")
def prediction_relationship(spark, d):
    g = _gap(spark, d).select("model_id", F.explode(F.array(F.col("seed").cast("string"), F.lit("all"))).alias("scope"), "p_forward", "gap")
    return g.groupBy("model_id", "scope").agg(F.count(F.lit(1)).alias("n"), rounded(T.guarded_pearson("p_forward", "gap")).alias("pearson"))


_RUNS = f"(SELECT model_id, fold_id, seed, avg(CASE WHEN p_forward >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1) AS recall, avg(CASE WHEN p_forward < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0) AS specificity, avg(gap) AS gap FROM {_GAP} GROUP BY ALL)"


def _runs(spark, d):
    hit = F.col("p_forward") >= 0.5
    share = lambda y, on: F.avg(F.when(F.col("label") == y, on.cast("double")))
    return _gap(spark, d).groupBy("model_id", "fold_id", "seed").agg(share(1, hit).alias("recall"), share(0, ~hit).alias("specificity"), F.avg("gap").alias("gap"))


@query(f"SELECT model_id, fold_id, seed, round(recall, 6) AS recall, round(specificity, 6) AS specificity, coalesce(recall < 0.5, false) OR coalesce(specificity <= 0, false) AS failed FROM {_RUNS}")
def failure_flags(spark, d):
    bad = F.coalesce(F.col("recall") < 0.5, F.lit(False)) | F.coalesce(F.col("specificity") <= 0, F.lit(False))
    return _runs(spark, d).select("model_id", "fold_id", "seed", rounded("recall").alias("recall"), rounded("specificity").alias("specificity"), bad.alias("failed"))


@query(f"SELECT model_id, round(high - low, 6) <= 0.05 AS narrow, round(middle, 6) AS median_recall, round(worst, 6) AS least_recall FROM (SELECT model_id, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high, median(recall) AS middle, min(recall) AS worst FROM {_RUNS} GROUP BY model_id)")
def gate_inputs(spark, d):
    g = _runs(spark, d).groupBy("model_id").agg(F.expr("percentile(gap, array(0.025, 0.975))").alias("q"), F.expr("percentile(recall, 0.5)").alias("m"), F.min("recall").alias("w"))
    return g.select("model_id", (rounded(F.col("q")[1] - F.col("q")[0]) <= 0.05).alias("narrow"), rounded("m").alias("median_recall"), rounded("w").alias("least_recall"))


@query(f"WITH r AS (SELECT model_id, seed, round(avg(gap), 6) AS x FROM {_GAP} GROUP BY ALL) SELECT b.model_id, bool_and(abs(b.x - a.x) <= 0.02) AS matched, round(max(abs(b.x - a.x)), 6) AS worst FROM r a JOIN r b ON a.seed = b.seed AND a.model_id = 0 AND b.model_id > 0 GROUP BY b.model_id")
def performance_match(spark, d):
    w = _gap(spark, d).groupBy("seed").pivot("model_id", [0, 1, 2]).agg(rounded(F.avg("gap")))
    x = w.select("seed", "0", F.explode(F.array(*(F.struct(F.lit(m).alias("model_id"), F.col(str(m)).alias("x")) for m in (1, 2)))).alias("c")).select("0", "c.*")
    off = F.abs(F.col("x") - F.col("0"))
    return x.groupBy("model_id").agg(F.every(off <= 0.02).alias("matched"), rounded(F.max(off)).alias("worst"))


@query(f"WITH dim AS (SELECT unnest([0, 1, 2, 3]) AS model_id), a AS (SELECT model_id, round(avg(gap), 6) AS x FROM {_GAP} WHERE model_id < 2 GROUP BY ALL), b AS (SELECT model_id, round(avg(gap), 6) AS x FROM {_GAP} WHERE model_id > 0 AND label = 1 GROUP BY ALL) "
       "SELECT CAST(model_id AS INTEGER) AS model_id, a.x AS main, b.x AS sensitivity, (a.x > 0.05) IS NOT DISTINCT FROM (b.x > 0.05) AS stable FROM dim LEFT JOIN a USING (model_id) LEFT JOIN b USING (model_id)")
def two_sided_comparison(spark, d):
    g, mean = _gap(spark, d), lambda x, name: x.groupBy("model_id").agg(rounded(F.avg("gap")).alias(name))
    dim = spark.createDataFrame([(m,) for m in range(4)], "model_id int")
    both = dim.join(mean(g.where("model_id < 2"), "main"), "model_id", "left").join(mean(g.where("model_id > 0 and label = 1"), "sensitivity"), "model_id", "left")
    return both.withColumn("stable", (F.col("main") > 0.05).eqNullSafe(F.col("sensitivity") > 0.05))


@query(f"SELECT model_id, count(*) FILTER (WHERE recall >= 0.5) AS good, round(min(recall), 6) AS least, round(avg(recall), 6) AS mean, round(sum(gap), 6) AS total, CAST(row_number() OVER (ORDER BY count(*) FILTER (WHERE recall >= 0.5) DESC, round(min(recall), 6) DESC, round(avg(recall), 6) DESC, model_id) AS INTEGER) AS place FROM {_RUNS} GROUP BY model_id")
def ranked_candidates(spark, d):
    g = _runs(spark, d).groupBy("model_id").agg(F.count_if(F.col("recall") >= 0.5).alias("good"), rounded(F.min("recall")).alias("least"), rounded(F.avg("recall")).alias("mean"), rounded(F.sum("gap")).alias("total"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("good"), F.desc("least"), F.desc("mean"), "model_id")))  # a row per model


@query(f"SELECT fold_id, seed, model_id, round(avg(gap), 6) AS mean, round(median(gap), 6) AS median, count(*) AS n FROM {_GAP} GROUP BY ALL")
def run_summary(spark, d):
    return _gap(spark, d).groupBy("fold_id", "seed", "model_id").agg(rounded(F.avg("gap")).alias("mean"), rounded(F.expr("percentile(gap, 0.5)")).alias("median"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT model_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS concordance, count(*) AS pairs FROM {V.PREDICTIONS} a JOIN {V.PREDICTIONS} b USING (model_id, seed) WHERE b.sample_id = a.sample_id + 1 GROUP BY model_id")
def label_concordance(spark, d):
    p = V.predictions(spark, d).select("model_id", "seed", "sample_id", "label")
    q = p.select("model_id", "seed", (F.col("sample_id") - 1).alias("sample_id"), F.col("label").alias("other"))
    return p.join(q, ["model_id", "seed", "sample_id"]).groupBy("model_id").agg(rounded(F.avg((F.col("label") == F.col("other")).cast("double"))).alias("concordance"), F.count(F.lit(1)).alias("pairs"))


@query(f"SELECT model_id, max(share) > 0.02 AS over_limit, bool_or(n > 0) AS some FROM (SELECT model_id, seed, avg(CASE WHEN gap > 0.3 THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (WHERE gap > 0.3) AS n FROM {_GAP} GROUP BY ALL) GROUP BY model_id")
def trigger_rule(spark, d):
    s = _gap(spark, d).groupBy("model_id", "seed").agg(F.avg((F.col("gap") > 0.3).cast("double")).alias("share"), F.count_if(F.col("gap") > 0.3).alias("n"))
    return s.groupBy("model_id").agg((F.max("share") > 0.02).alias("over_limit"), F.bool_or(F.col("n") > 0).alias("some"))


@query(f"SELECT field, value, count(*) AS n, round(avg(p_forward), 6) AS mean FROM (SELECT 'fold' AS field, CAST(fold_id AS VARCHAR) AS value, p_forward FROM {_GAP} UNION ALL SELECT 'seed', CAST(seed AS VARCHAR), p_forward FROM {_GAP} UNION ALL SELECT 'label', CAST(label AS VARCHAR), p_forward FROM {_GAP}) GROUP BY ALL")
def partition_balance(spark, d):
    p = V.predictions(spark, d).select("p_forward", *(F.col(c).cast("string").alias(n) for c, n in (("fold_id", "fold"), ("seed", "seed"), ("label", "label"))))
    return p.unpivot(["p_forward"], ["fold", "seed", "label"], "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("p_forward")).alias("mean"))


# --- nested results --------------------------------------------------------------------------------------------------

@query("SELECT lang, 'n' AS method, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang UNION ALL SELECT lang, 'chars', CAST(sum(n_chars) AS DOUBLE) FROM documents GROUP BY lang")
def nested_results(spark, d):
    g = V.read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars"))
    text = g.select(F.to_json(F.create_map(F.col("lang"), F.create_map(F.lit("n"), F.col("n"), F.lit("chars"), F.col("chars")))).alias("j"))
    tasks = text.select(F.explode(F.from_json("j", "map<string,map<string,double>>")).alias("lang", "methods"))
    return tasks.select("lang", F.explode("methods").alias("method", "value"))


@query(f"SELECT model_id, CASE WHEN x > 0.05 THEN 'wide' ELSE 'narrow' END AS decision FROM (SELECT model_id, round(avg(gap), 6) AS x FROM {_GAP} GROUP BY ALL)")
def decision_map(spark, d):
    g = _gap(spark, d).groupBy("model_id").agg(rounded(F.avg("gap")).alias("x"))
    rows = g.agg(F.map_from_entries(F.collect_list(F.struct("model_id", F.when(F.col("x") > 0.05, "wide").otherwise("narrow")))).alias("m"))  # a row per model
    return rows.select(F.explode("m").alias("model_id", "decision"))


# --- attributions ----------------------------------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(range(0, 16), lambda i: [CAST(embedding[4 * (15 - i) + 4 - j] AS DOUBLE) FOR j IN range(0, 4)]) AS rc FROM embeddings")
def rc_one_hot(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    m = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(e, 4 * i + 1, F.lit(4)))
    return V.read(spark, d, "embeddings").select("vec_id", A.reverse_complement_matrix(m).alias("rc"))


@query("SELECT vec_id, list_concat(list_reverse(e[33:64]), list_reverse(e[1:32])) AS swapped FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def swapped_halves(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return V.read(spark, d, "embeddings").select("vec_id", F.concat(F.reverse(F.slice(e, 33, 32)), F.reverse(F.slice(e, 1, 32))).alias("swapped"))


_BOTH = f"(SELECT sample_id, unnest(fwd) AS x, unnest(rc) AS y FROM {V.ATTRIBUTIONS})"
_TOP = "list_transform(list_sort(list_transform(range(1, 65), lambda i: {{'m': -abs({0}[i]), 'i': i}}))[1:10], lambda s: s.i)"


@query(f"WITH c AS (SELECT sample_id, {_CORR.format('x', 'y')} AS pearson, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM {_BOTH} GROUP BY sample_id) "
       f"SELECT sample_id, round(len(list_intersect({_TOP.format('fwd')}, {_TOP.format('rc')})) / 10.0::DOUBLE, 6) AS top, pearson, cosine, CASE WHEN pearson IS NULL THEN 'constant' END AS issue FROM {V.ATTRIBUTIONS} JOIN c USING (sample_id)")
def attribution_consistency(spark, d):
    a = V.attributions(spark, d)
    pairs = a.select("sample_id", F.explode(F.arrays_zip("fwd", "rc")).alias("z")).select("sample_id", F.col("z.fwd").alias("x"), F.col("z.rc").alias("y"))
    cosine = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))
    c = pairs.groupBy("sample_id").agg(rounded(T.guarded_pearson("x", "y")).alias("pearson"), rounded(cosine).alias("cosine"))
    top = rounded(A.top_overlap(F.col("fwd"), F.col("rc"), 10)).alias("top")
    return a.select("sample_id", top).join(c, "sample_id").withColumn("issue", F.when(F.col("pearson").isNull(), "constant"))


_MASS = "list_sum(list_transform(fwd[{0}:{1}], lambda z: abs(z)))"
_ALL = _MASS.format(1, 64)


@query(f"SELECT sample_id, round(core, 6) AS core, round(near, 6) AS near, round(greatest(0.0, 1 - core - near), 6) AS background, round((core / 16) / (greatest(0.0, 1 - core - near) / 32), 6) AS enrichment FROM (SELECT sample_id, {_MASS.format(25, 40)} / {_ALL} AS core, ({_MASS.format(17, 24)} + {_MASS.format(41, 48)}) / {_ALL} AS near FROM {V.ATTRIBUTIONS})")
def region_masses(spark, d):
    a = F.col("fwd")
    m = V.attributions(spark, d).select("sample_id", A.mass_fraction(a, 24, 40).alias("core"), (A.mass_fraction(a, 16, 24) + A.mass_fraction(a, 40, 48)).alias("near"))
    m = m.withColumn("rest", F.greatest(F.lit(0.0), 1 - F.col("core") - F.col("near")))
    return m.select("sample_id", rounded("core").alias("core"), rounded("near").alias("near"), rounded("rest").alias("background"), rounded(F.try_divide(F.col("core") / 16, F.col("rest") / 32)).alias("enrichment"))
