"""Registered queries that choose rows: cascades, splits, cohorts, motif edits and scans, pairs of two sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import arrays as A
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import motifs as P
from ..operators import pieces as Q
from ..operators import similarity as X
from ..sources import synthetic as Y
from . import fixtures as V
from .registry import query, rounded

# --- cascades --------------------------------------------------------------------------------------------------------

_AT = "p.chrom = a.chrom AND p.start_bp - {0} < a.end_bp AND a.start_bp < p.end_bp + {0}"
_FLAGS = (
    f"(SELECT p.*, EXISTS (SELECT 1 FROM {V.peaks_sql()} a WHERE a.score < 50 AND {_AT.format(0)}) AS listed, "
    f"EXISTS (SELECT 1 FROM {V.ACCESSIBLE} a WHERE {_AT.format(0)}) AS open, EXISTS (SELECT 1 FROM {V.peaks_sql()} a WHERE a.score >= 900 AND {_AT.format(128)}) AS target FROM {V.peaks_sql()} p WHERE score >= 50 AND score < 900)"
)
_REASON = "CASE WHEN end_bp > 19999000 THEN 'out_of_bounds' WHEN listed THEN 'blacklist' WHEN NOT open THEN 'no_accessibility' WHEN target THEN 'near_target' ELSE 'retained' END"


def _flags(spark, d):
    """Candidates with what the cascades ask: overlaps with listed regions, open regions, and targets with their buffer."""
    p = V.peaks(spark, d)
    x = p.where("score >= 50 and score < 900")
    wide = p.where("score >= 900").withColumns({"start_bp": F.col("start_bp") - 128, "end_bp": F.col("end_bp") + 128})
    for name, other in (("listed", p.where("score < 50")), ("open", V.accessible(spark, d)), ("target", wide)):
        hit = I.overlapping(x.select("id", "chrom", "start_bp", "end_bp"), other).select("id", F.lit(True).alias(name)).distinct()
        x = x.join(hit, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return x


def _reason(ask_open: bool = True):
    r = F.when(F.col("end_bp") > 19_999_000, "out_of_bounds").when(F.col("listed"), "blacklist")
    r = r.when(~F.col("open"), "no_accessibility") if ask_open else r
    return r.when(F.col("target"), "near_target").otherwise("retained")


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM {_FLAGS} GROUP BY 1")
def negative_cascade(spark, d):
    return _flags(spark, d).groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, open, {_REASON.replace(chr(87) + 'HEN NOT open THEN ' + chr(39) + 'no_accessibility' + chr(39) + ' ', '')} AS reason FROM {_FLAGS}")
def flagged_cascade(spark, d):
    return _flags(spark, d).select("id", "open", _reason(ask_open=False).alias("reason"))


_MATCHED = f"(SELECT lang, gc_bin, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {V.STRATA} GROUP BY ALL)"


@query(f"SELECT CAST(sum(least(p, n)) AS BIGINT) AS pairs, CAST(sum(p) - sum(least(p, n)) AS BIGINT) AS unmatched, round(sum(least(p, n)) / sum(p), 6) AS rate FROM {_MATCHED}")
def match_accounting(spark, d):
    g = V.strata(spark, d).groupBy("lang", "gc_bin").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    pairs = F.sum(F.least("p", "n"))
    return g.agg(pairs.alias("pairs"), (F.sum("p") - pairs).alias("unmatched"), rounded(F.try_divide(pairs, F.sum("p"))).alias("rate"))


_PAIRS = f"(SELECT doc_id // 2 AS pair_id, doc_id, CAST(quality AS INTEGER) AS label, lang, source FROM documents JOIN labels USING (doc_id))"


def _marked(spark, d):
    x = V.read(spark, d, "documents").join(V.read(spark, d, "labels"), "doc_id")
    return x.select(F.floor(F.col("doc_id") / 2).alias("pair_id"), "doc_id", F.col("quality").cast("int").alias("label"), "lang", "source")


@query(f"SELECT count(*) AS pairs, count(*) FILTER (WHERE n = 2 AND labels = 2) AS whole, count(*) FILTER (WHERE n <> 2) AS broken FROM (SELECT pair_id, count(*) AS n, count(DISTINCT label) AS labels FROM {_PAIRS} GROUP BY pair_id)")
def pair_integrity(spark, d):
    g = _marked(spark, d).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))
    whole = (F.col("n") == 2) & (F.col("labels") == 2)
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(whole).alias("whole"), F.count_if(F.col("n") != 2).alias("broken"))


# --- splits and cohorts ----------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN source IN ('src0', 'src1') THEN 'test' WHEN source = 'src2' THEN 'validation' ELSE 'train' END"


def _split():
    return F.when(F.col("source").isin("src0", "src1"), "test").when(F.col("source") == "src2", "validation").otherwise("train")


@query(f"SELECT count(*) FILTER (WHERE s <> 'test') AS kept, count(*) FILTER (WHERE s = 'test') AS sealed, bool_and(s IN ('train', 'validation', 'test')) AS known FROM (SELECT {_SPLIT} AS s FROM documents)")
def sealed_split(spark, d):
    s = V.read(spark, d, "documents").select(_split().alias("s"))
    return s.agg(F.count_if(F.col("s") != "test").alias("kept"), F.count_if(F.col("s") == "test").alias("sealed"), F.every(F.col("s").isin("train", "validation", "test")).alias("known"))


@query(f"SELECT doc_id, pair_id FROM (SELECT *, bool_or(lang = 'de') OVER (PARTITION BY pair_id) AS bad FROM {_PAIRS}) WHERE NOT bad")
def whole_pairs_kept(spark, d):
    bad = F.max((F.col("lang") == "de").cast("int")).over(Window.partitionBy("pair_id"))
    return _marked(spark, d).withColumn("bad", bad).where("bad = 0").select("doc_id", "pair_id")


@query(f"SELECT doc_id, s AS split FROM (SELECT doc_id, label, {_SPLIT} AS s FROM {_PAIRS}) WHERE NOT (s = 'train' AND label = 0)")
def excluded_from_train(spark, d):
    x = _marked(spark, d).select("doc_id", "label", _split().alias("split"))
    out = x.where("label = 0").select("doc_id", F.lit("train").alias("split"))
    return x.join(out, ["doc_id", "split"], "left_anti").select("doc_id", "split")


@query(f"SELECT doc_id, s AS split, label FROM (SELECT *, row_number() OVER (PARTITION BY s, label ORDER BY doc_id) AS n FROM (SELECT doc_id, label, {_SPLIT} AS s FROM {_PAIRS})) WHERE n <= 8")
def smoke_rows(spark, d):
    x = _marked(spark, d).select("doc_id", "label", _split().alias("split"))
    return M.top_per_group(x, ["split", "label"], ["doc_id"], 8).select("doc_id", "split", "label")


@query(f"SELECT CAST(f AS INTEGER) AS fold, CASE WHEN h = f THEN 'validation' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT chrom) AS chroms FROM (SELECT chrom, CAST(substr(chrom, 4) AS INTEGER) % 3 AS h FROM {V.peaks_sql()}), range(3) t(f) GROUP BY ALL")
def fold_views(spark, d):
    p = V.peaks(spark, d).select("chrom", (F.substring("chrom", 4, 9).cast("int") % 3).alias("h"), F.explode(F.array(*map(F.lit, range(3)))).alias("fold"))
    split = F.when(F.col("h") == F.col("fold"), "validation").otherwise("train")
    return p.groupBy("fold", split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("chroms"))


@query(f"SELECT id FROM (SELECT id FROM {V.peaks_sql()} ORDER BY sha256('7:' || id), id LIMIT 200)")
def seeded_sample(spark, d):
    return V.peaks(spark, d).orderBy(S.stable_rank(F.col("id"), 7), "id").select("id").limit(200)


@query(f"WITH c AS (SELECT DISTINCT sample_id FROM {V.PREDICTIONS} WHERE label = 1) SELECT model_id, seed, count(*) AS n, count(*) = (SELECT count(*) FROM c) AS complete FROM {V.PREDICTIONS} JOIN c USING (sample_id) GROUP BY ALL")
def cohort_completeness(spark, d):
    p = V.predictions(spark, d)
    c = p.where("label = 1").select("sample_id").distinct()
    g = p.join(c, "sample_id", "left_semi").groupBy("model_id", "seed").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(c.agg(F.count(F.lit(1)).alias("all"))), F.lit(True)).select("model_id", "seed", "n", (F.col("n") == F.col("all")).alias("complete"))


@query(f"SELECT chrom, id FROM (SELECT chrom, id, row_number() OVER (PARTITION BY chrom ORDER BY start_bp, id) AS n FROM {V.peaks_sql()}) WHERE n = 1")
def spot_checks(spark, d):
    first = F.min_by("id", F.struct("start_bp", "id"))
    return V.peaks(spark, d).groupBy("chrom").agg(first.alias("id"))


@query(f"WITH g AS (SELECT sample_id, seed, model_id, round(abs(p_forward - p_rc), 9) AS x FROM {V.PREDICTIONS}), m AS (SELECT model_id, median(x) AS m FROM g GROUP BY model_id) SELECT model_id, sample_id, seed FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(abs(x - m), 9), sample_id, seed) AS n FROM g JOIN m USING (model_id)) WHERE n = 1")
def representatives(spark, d):
    g = V.predictions(spark, d).select("sample_id", "seed", "model_id", F.round(F.abs(F.col("p_forward") - F.col("p_rc")), 9).alias("x"))
    m = g.groupBy("model_id").agg(F.expr("percentile(x, 0.5)").alias("m"))
    near = F.struct(F.round(F.abs(F.col("x") - F.col("m")), 9).alias("off"), "sample_id", "seed")
    return g.join(m, "model_id").groupBy("model_id").agg(F.min(near).alias("best")).select("model_id", "best.sample_id", "best.seed")


@query()
def nearest_subset(spark, d):
    counts = dict(V.peaks(spark, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).collect())  # 22 rows at most
    names = M.nearest_subset(counts, 0.3 * sum(counts.values()), 2, 8)
    return spark.createDataFrame([(",".join(names), sum(counts[c] for c in names))], "names string, total long")


_SIDES = "(SELECT CAST(o_custkey % 8 AS INTEGER) AS g, unnest([{m: 0, v: o_orderkey * 7919 % 1000, p: 1}, {m: 0, v: o_orderkey * 104729 % 1000, p: 0}, {m: 1, v: o_orderkey * 31337 % 997, p: 1}, {m: 1, v: o_orderkey * 27449 % 997, p: 0}], recursive := true) FROM orders)"
_ASK = "abs(n - total * 0.4::DOUBLE), size, names"


@query(f"WITH t AS (SELECT g, m, v, sum(p) AS p, sum(1 - p) AS q FROM {_SIDES} GROUP BY ALL), n AS (SELECT g, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT o_custkey % 8 AS g FROM orders) GROUP BY g), "
       "c AS (SELECT i AS mask, sum(n) AS n, max(n) AS largest, count(*) AS size, list('g' || g ORDER BY g) AS names, any_value(total) AS total FROM range(1, 256) r(i) JOIN n ON (i >> CAST(g AS BIGINT)) & 1 = 1 GROUP BY i), "
       "s AS (SELECT i AS mask, m, v, sum(p) AS p, sum(q) AS q FROM range(1, 256) r(i) JOIN t ON (i >> CAST(g AS BIGINT)) & 1 = 1 GROUP BY ALL), "
       "d AS (SELECT mask, m, sum(p) OVER w / sum(p) OVER a AS x, sum(q) OVER w / sum(q) OVER a AS y FROM s WINDOW a AS (PARTITION BY mask, m), w AS (PARTITION BY mask, m ORDER BY v DESC ROWS UNBOUNDED PRECEDING)), "
       "ok AS (SELECT mask FROM d GROUP BY mask HAVING max(abs(x - y)) <= 0.1), "
       f"e AS (SELECT mask, names FROM c WHERE size BETWEEN 3 AND 6 AND n >= 200 AND largest <= 0.5 * n AND mask IN (FROM ok) AND 255 - mask IN (FROM ok) ORDER BY {_ASK} LIMIT 1), "
       f"f AS (SELECT c.names, row_number() OVER (ORDER BY abs(n - total * 0.4::DOUBLE), size, c.names) AS k FROM c, e WHERE c.mask & e.mask = 0 AND size <= 6 AND n >= 200 AND c.mask IN (FROM ok) AND 255 - e.mask - c.mask IN (FROM ok)) "
       "SELECT 'test' AS part, unnest(names) AS name FROM e UNION ALL SELECT 'validation ' || k, unnest(names) FROM f WHERE k <= 3")
def balanced_folds(spark, d):
    o = V.read(spark, d, "orders").select(F.concat(F.lit("g"), (F.col("o_custkey") % 8).cast("string")).alias("g"), F.col("o_orderkey").cast("long").alias("k"))
    measures = [(F.col("k") * a % m, F.col("k") * b % m) for a, b, m in ((7919, 104729, 1000), (31337, 27449, 997))]
    return M.fixed_test_and_folds(o, "g", measures, [f"g{i}" for i in range(8)], share=0.4)


# --- motifs ----------------------------------------------------------------------------------------------------------

_MOTIF = {"A": [3.0, 10.0, 0.0, 18.0], "C": [5.0, 2.0, 0.0, 1.0], "G": [9.0, 4.0, 19.0, 0.0], "T": [3.0, 4.0, 1.0, 1.0]}
_PWM = A.pwm_weights(_MOTIF)
_LOW, _HIGH = (sum(f(c.values()) for c in _PWM) for f in (min, max))


def _score(k: str) -> str:
    cases = (f"CASE substr({k}, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN CAST({w!r} AS DOUBLE)" for b, w in c.items()) + " END" for i, c in enumerate(_PWM))
    return f"round({' + '.join(cases)}, 9)"


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_KMER = f"(SELECT doc_id AS id, seq, unnest(range(0, 253)) AS start FROM {V.DNA})"
_HITS = (
    f"(SELECT id, seq, start, strand, score, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score - {_LOW!r}::DOUBLE) / {_HIGH - _LOW!r}::DOUBLE)) AS relative FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, strand) AS n FROM ("
    f"SELECT id, seq, start, '+' AS strand, {_score('substr(seq, start + 1, 4)')} AS score FROM {_KMER} UNION ALL SELECT id, seq, start, '-', {_score(_RC.format('substr(seq, start + 1, 4)'))} FROM {_KMER})) WHERE n = 1)"
)


@query(f"SELECT id, CAST(start AS INTEGER) AS start, strand, round(relative, 6) AS relative, round(relative, 9) >= 0.8 AS at80, round(relative, 9) >= 0.85 AS at85, round(relative, 9) >= 0.9 AS at90 FROM {_HITS}")
def scanned_cohort(spark, d):
    h = A.pwm_best_hits(V.dna(spark, d), "doc_id", "seq", _PWM)
    flags = (((rounded("relative", 9)) >= t).alias(f"at{int(100 * t)}") for t in (0.8, 0.85, 0.9))
    return h.select("id", "start", "strand", rounded("relative").alias("relative"), *flags)


_WEAK = P.weakest_bases(_PWM)
_TARGET = {s: [{b: P.disrupting_base(_PWM, s, i, b) for b in "ACGT"} for i in range(4)] for s in "+-"}


def _edited(strand: str) -> str:
    bases = (f"CASE substr(seq, start + {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN '{t}'" for b, t in c.items()) + " END" for i, c in enumerate(_TARGET[strand]))
    return f"substr(seq, 1, start) || {' || '.join(bases)} || substr(seq, start + 5)"


_EDITED = f"(SELECT id, seq, start, strand, score, CASE strand WHEN '+' THEN {_edited('+')} ELSE {_edited('-')} END AS mutant FROM {_HITS})"


@query(f"SELECT id, mutant, round(score - CASE strand WHEN '+' THEN {_score('substr(mutant, start + 1, 4)')} ELSE {_score(_RC.format('substr(mutant, start + 1, 4)'))} END, 6) AS lost FROM {_EDITED}")
def disrupted_motifs(spark, d):
    s = V.dna(spark, d).select(F.col("doc_id").alias("id"), "seq")
    e = P.disrupt(s.join(A.pwm_best_hits(s, "id", "seq", _PWM), "id"), "seq", _PWM)
    k = F.substr("mutant", F.col("start") + 1, F.lit(4))
    after = F.round(A.pwm_score(F.when(F.col("strand") == "+", k).otherwise(S.revcomp(k)), _PWM), 9)
    return e.select("id", "mutant", rounded(F.col("score") - after).alias("lost"))


@query(f"SELECT sum(relative >= 0.8 AND s = 'train')::BIGINT AS train80, sum(relative >= 0.9 AND s = 'train')::BIGINT AS train90, sum(relative >= 0.8 AND s = 'test')::BIGINT AS test80, count(*) AS n FROM (SELECT round(relative, 9) AS relative, {_SPLIT} AS s FROM {_HITS} h JOIN documents ON doc_id = h.id // {V.WINDOWS})")
def motif_prevalence(spark, d):
    h = A.pwm_best_hits(V.dna(spark, d), "doc_id", "seq", _PWM).select("id", rounded("relative", 9).alias("relative"))
    x = h.join(V.dna(spark, d).select(F.col("doc_id").alias("id"), _split().alias("s")), "id")
    on = lambda t, s: F.count_if((F.col("relative") >= t) & (F.col("s") == s))
    return x.agg(on(0.8, "train").alias("train80"), on(0.9, "train").alias("train90"), on(0.8, "test").alias("test80"), F.count(F.lit(1)).alias("n"))


_NEAR = ("GATAAGAT", "CCGCGAGG")
_SCAN = " UNION ALL ".join(f"SELECT id, start, {i} AS motif, {o} AS orientation, hamming({k}, '{m}') AS distance FROM w" for i, m in enumerate(_NEAR) for o, k in ((0, "k"), (1, _RC.format("k"))))


@query(f"WITH w AS (SELECT id, start, substr(seq, start + 1, 8) AS k FROM (SELECT doc_id AS id, seq, unnest(range(0, 249)) AS start FROM {V.DNA})), s AS ({_SCAN}) "
       "SELECT id, CAST(start AS INTEGER) AS start, motif, distance FROM (SELECT *, row_number() OVER (PARTITION BY id, start ORDER BY distance, motif, orientation) AS n FROM s WHERE distance <= 2) WHERE n = 1")
def near_motifs(spark, d):
    return P.near_motif_scan(V.dna(spark, d), "doc_id", "seq", list(_NEAR), 2).select("id", "start", "motif", F.col("distance").cast("long").alias("distance"))


# --- two sets of sequences -------------------------------------------------------------------------------------------

_H15 = f"(SELECT id, side, h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS n FROM (SELECT DISTINCT doc_id AS id, lang = 'en' AS side, md5(least(k, {_RC.format('k')})) AS h FROM (SELECT doc_id, lang, unnest(list_transform(range(1, 243), lambda i: substr(seq, i, 15))) AS k FROM {V.DNA}))) WHERE n <= 128)"


@query(f"WITH p AS {_H15}, u AS (SELECT h FROM p WHERE NOT side GROUP BY h HAVING count(*) <= 256) SELECT a.id AS a, b.id AS b, count(*) AS shared, round(count(*) / greatest(1, 256 - count(*))::DOUBLE, 6) AS jaccard FROM p a JOIN p b USING (h) JOIN u USING (h) WHERE a.side AND NOT b.side GROUP BY ALL HAVING count(*) >= 8")
def cross_set_candidates(spark, d):
    s = V.dna(spark, d)
    post = lambda where: X.bottom_k(s.where(where), "doc_id", "seq", 15, 128)
    c = X.cross_candidates(post("lang = 'en'"), post("lang <> 'en'"), 256, 8)
    return c.select("a", "b", "shared", rounded(F.col("shared") / F.greatest(F.lit(1), 256 - F.col("shared"))).alias("jaccard"))


@query(f"SELECT a, b, (x.lang <> y.lang OR x.source <> y.source) AS crosses FROM (SELECT x.doc_id AS a, y.doc_id AS b FROM {V.DNA} x JOIN {V.DNA} y ON x.doc_id < y.doc_id AND hamming(x.seq, y.seq) <= 2) JOIN {V.DNA} x ON x.doc_id = a JOIN {V.DNA} y ON y.doc_id = b")
def crossing_pairs(spark, d):
    s = V.dna(spark, d)
    p = X.block_pairs(s, "doc_id", "seq", 256, 2).select("a", "b")
    for c in "ab":
        p = p.join(s.select(F.col("doc_id").alias(c), F.col("lang").alias(f"{c}_lang"), F.col("source").alias(f"{c}_source")), c)
    crosses = (F.col("a_lang") != F.col("b_lang")) | (F.col("a_source") != F.col("b_source"))
    return p.select("a", "b", crosses.alias("crosses"))


_CLOSE = f"(SELECT x.doc_id AS a, y.doc_id AS b, x.seq AS sa, y.seq AS sb FROM {V.DNA} x JOIN {V.DNA} y ON x.doc_id < y.doc_id AND hamming(x.seq, y.seq) <= 2)"
_SHIFTED = f"(SELECT a, b, o, s, substr(sa, greatest(s, 0) + 1) AS x, substr(CASE o WHEN 0 THEN sb ELSE {_RC.format('sb')} END, greatest(-s, 0) + 1) AS y FROM {_CLOSE}, range(2) q(o), range(-3, 4) r(s))"
_ALIGNED = f"(SELECT a, b, o, s, round(1 - levenshtein(x[1:n], y[1:n]) / n::DOUBLE, 9) AS identity, round(n / 256.0::DOUBLE, 9) AS coverage FROM (SELECT *, least(length(x), length(y)) AS n FROM {_SHIFTED}))"


@query(f"SELECT a, b, identity, coverage, CASE o WHEN 0 THEN 'forward' ELSE 'reverse' END AS orientation, CAST(s AS INTEGER) AS shift, CASE WHEN least(identity, coverage) >= 0.9 THEN 'primary' WHEN least(identity, coverage) >= 0.8 THEN 'sensitivity' END AS edge "
       f"FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY identity DESC, coverage DESC, o, abs(s), s) AS n FROM {_ALIGNED}) WHERE n = 1")
def classed_alignments(spark, d):
    s = V.dna(spark, d)
    p = X.block_pairs(s, "doc_id", "seq", 256, 2).select("a", "b")
    for c in "ab":
        p = p.join(s.select(F.col("doc_id").alias(c), F.col("seq").alias(f"s{c}")), c)
    return X.exhaustive_alignment(p, 3).withColumn("edge", X.edge_class(F.col("identity"), F.col("coverage")))


_SKETCH = f"(SELECT h, count(*) AS df FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS n FROM (SELECT DISTINCT doc_id AS id, md5(least(k, {_RC.format('k')})) AS h FROM (SELECT doc_id, unnest(list_transform(range(1, 246), lambda i: substr(seq, i, 12))) AS k FROM {V.DNA}))) WHERE n <= 96 GROUP BY h)"


@query(f"SELECT count(*) AS hashes, count(*) FILTER (WHERE df > 20) AS excluded, CAST(sum(df * (df - 1) // 2) FILTER (WHERE df <= 20) AS BIGINT) AS collisions FROM {_SKETCH}")
def sketch_counters(spark, d):
    g = Q.sketch_counts(V.dna(spark, d), "seq", 12, 96, Q.by_md5)
    pairs = F.sum(F.when(F.col("df") <= 20, F.floor(F.col("df") * (F.col("df") - 1) / 2)))
    return g.agg(F.count(F.lit(1)).alias("hashes"), F.count_if(F.col("df") > 20).alias("excluded"), pairs.alias("collisions"))


_MID = "substr({0}, 127, 4)"


@query(f"SELECT doc_id, {_score(_MID.format('seq'))} AS forward, {_score(_MID.format(_RC.format('seq')))} AS reverse, ({_score(_MID.format('seq'))} >= 0) <> ({_score(_MID.format(_RC.format('seq')))} >= 0) AS flips FROM {V.DNA}")
def orientation_scores(spark, d):
    score = lambda s: F.round(A.pwm_score(F.substring(s, 127, 4), _PWM), 9)
    x = V.dna(spark, d).select("doc_id", score(F.col("seq")).alias("forward"), score(S.revcomp(F.col("seq"))).alias("reverse"))
    return x.withColumn("flips", (F.col("forward") >= 0) != (F.col("reverse") >= 0))


@query(f"SELECT doc_id, 'forward' AS view, seq FROM {V.DNA} UNION ALL SELECT doc_id, 'reverse', {_RC.format('seq')} FROM {V.DNA}")
def paired_views(spark, d):
    s = V.dna(spark, d).select("doc_id", F.lit("forward").alias("view"), "seq")
    return s.unionByName(s.select("doc_id", F.lit("reverse").alias("view"), S.revcomp(F.col("seq")).alias("seq")))


@query(f"SELECT DISTINCT 'fold' || fold_id || '__model' || model_id || '__seed_' || seed AS run FROM {V.PREDICTIONS}")
def run_names(spark, d):
    name = F.concat_ws("__", F.concat(F.lit("fold"), "fold_id"), F.concat(F.lit("model"), "model_id"), F.concat(F.lit("seed_"), "seed"))
    return V.predictions(spark, d).select(name.alias("run")).distinct()


@query(f"SELECT a.sample_id, a.seed, a.p_forward AS absolute_forward, a.p_rc AS absolute_rc, b.p_forward AS relative_forward FROM {V.PREDICTIONS} a JOIN {V.PREDICTIONS} b USING (fold_id, seed, sample_id, label) WHERE a.model_id = 0 AND b.model_id = 1 AND b.p_forward >= 0.5")
def joined_scans(spark, d):
    p, keys = V.predictions(spark, d), ["fold_id", "seed", "sample_id", "label"]
    a = p.where("model_id = 0").select(*keys, F.col("p_forward").alias("absolute_forward"), F.col("p_rc").alias("absolute_rc"))
    b = p.where("model_id = 1 and p_forward >= 0.5").select(*keys, F.col("p_forward").alias("relative_forward"))
    return a.join(b, keys).select("sample_id", "seed", "absolute_forward", "absolute_rc", "relative_forward")


_UNIQUE = f"(SELECT seq, min(doc_id) AS id, count(*) AS n, count(DISTINCT lang) AS langs FROM (SELECT least(seq, {_RC.format('seq')}) AS seq, doc_id, lang FROM {V.DNA}) GROUP BY 1)"


@query(f"SELECT count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS repeated, count(*) FILTER (WHERE langs > 1) AS conflicts FROM {_UNIQUE}")
def dedup_counters(spark, d):
    g = V.dna(spark, d).groupBy(S.canonical(F.col("seq")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))
    return g.agg(F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.count_if(F.col("langs") > 1).alias("conflicts"))


# --- synthetic sequences ---------------------------------------------------------------------------------------------

_MADE = {"test": 300, "train": 1200, "validation": 300}
_STEP = {1200: 743, 300: 187}
_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS split, '{s}_' || lpad(CAST(i AS VARCHAR), 6, '0') AS sample_id, CAST((i * {_STEP[n]} + 7) % {n} < {n // 2} AS INTEGER) AS label, '7:{s}:' || i || ':0' AS key FROM range({n}) t(i)" for s, n in _MADE.items())
_U = "CAST('0x' || substr(sha256({0} || ':{1}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"
_DRAWN = "array_to_string(list_transform(range(0, 200), lambda i: list_extract(['T', 'A', 'C', 'G'], CAST(1 + 2 * CAST(w[1 + i] < 32768 AS INTEGER) + CAST(w[1 + i] % 2 = 0 AS INTEGER) AS BIGINT))), '')"
_WORDS = "list_transform(range(0, 200), lambda i: CAST('0x' || substr(sha256({0} || ':letters:' || (i // 16)), 1 + 4 * (i % 16), 4) AS INTEGER))"


@query(f"WITH r AS ({_ROWS}), w AS (SELECT *, {_WORDS.format('key || chr(58) || a')} AS w FROM r, range(16) t(a) WHERE label = 0 OR a = 0), s AS (SELECT * EXCLUDE (w), {_DRAWN} AS s FROM w), "
       "n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a) AS k FROM s WHERE label = 1 OR NOT (contains(s, 'TGACTCAG') OR contains(s, 'CTGAGTCA'))), "
       f"m AS (SELECT *, CASE WHEN label = 1 THEN CAST(floor({_U.format('key', 'start')} * 193) AS INTEGER) END AS motif_start, CASE WHEN label = 1 THEN {_U.format('key', 'strand')} < 0.5 END AS ahead FROM n WHERE k = 1) "
       "SELECT split, sample_id, label, motif_start, motif_start + 8 AS motif_end, CASE ahead WHEN true THEN 'forward' WHEN false THEN 'reverse_complement' END AS motif_orientation, CASE WHEN label = 1 THEN substr(s, 1, motif_start) || CASE WHEN ahead THEN 'TGACTCAG' ELSE 'CTGAGTCA' END || substr(s, motif_start + 9) ELSE s END AS sequence FROM m")
def synthetic_motifs(spark, d):
    return Y.planted_motifs(spark, _MADE, "TGACTCAG", 200, 7).drop("redraw")


_INEXACT = "array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN CAST('0x' || substr(sha256(key || ':{0}:keep:' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < 0.9 THEN substr('{1}', i + 1, 1) ELSE substr(replace('ACGT', substr('{1}', i + 1, 1), ''), 1 + CAST(floor(3 * (CAST('0x' || substr(sha256(key || ':{0}:other:' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)) AS INTEGER), 1) END), '')"
_TURN = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query(f"WITH r AS ({_ROWS}), w AS (SELECT *, {_WORDS.format('key')} AS w, label = 0 AND {_U.format('key', 'wrong')} < 0.5 AS far, {_U.format('key', 'mirror')} < 0.5 AS ba, {_INEXACT.format('a', 'GGAACC')} AS ia, {_INEXACT.format('b', 'TATAGC')} AS ib FROM r), "
       f"g AS (SELECT *, {_DRAWN} AS s, CASE WHEN far THEN 40 + CAST(floor({_U.format('key', 'gap')} * 25) AS INTEGER) ELSE 10 + CAST(floor({_U.format('key', 'gap')} * 15) AS INTEGER) END AS gap, CASE WHEN ba THEN ib ELSE ia END AS l, CASE WHEN ba THEN ia ELSE ib END AS o FROM w), "
       f"p AS (SELECT *, CASE WHEN label = 1 OR far THEN {_TURN.format('o')} ELSE o END AS q, CAST(floor({_U.format('key', 'start')} * (200 - 12 - gap + 1)) AS INTEGER) AS a FROM g) "
       f"SELECT split, sample_id, CASE WHEN split = 'train' AND {_U.format(chr(39) + '7:' + chr(39) + ' || sample_id', 'noise')} < 0.1 THEN 1 - label ELSE label END AS label, label AS clean_label, CASE WHEN ba THEN 'B' ELSE 'A' END AS left_motif, a AS left_start, a + 6 AS left_end, a + 6 + gap AS right_start, a + 12 + gap AS right_end, gap, "
       "substr(s, 1, a) || l || substr(s, a + 7, gap) || q || substr(s, a + 13 + gap) AS sequence FROM p")
def synthetic_grammar(spark, d):
    return Y.motif_grammar(spark, _MADE, ("GGAACC", "TATAGC"), 200, 7, match=0.9, noise={"train": 0.1}).drop("redraw")
