"""Registered queries: rows per pair and per view, positions of an edit, sequences annotated with their motifs, prevalence by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import arrays as A
from ..operators import matching as M
from ..operators import motifs as P
from . import fixtures as V
from .cohorts import _HITS, _NEAR, _PWM, _RC, _SCAN
from .registry import query, rounded

# --- pairs and views -------------------------------------------------------------------------------------------------

_SIDE = "(SELECT *, row_number() OVER (PARTITION BY lang, gc_bin ORDER BY {1}) AS n FROM {0} WHERE label = {2})"
_PAIRS = (
    f"(SELECT p.lang, p.gc_bin, p.doc_id AS pos, q.doc_id AS neg, row_number() OVER (ORDER BY p.lang, p.gc_bin, p.doc_id) AS number FROM {_SIDE.format(V.STRATA, 'doc_id', 1)} p "
    f"JOIN {_SIDE.format(V.STRATA, chr(34) + 'sha' + chr(34) + ', doc_id', 0).replace('FROM ' + V.STRATA, 'FROM (SELECT *, sha256(' + chr(39) + '11:' + chr(39) + ' || doc_id) AS sha FROM ' + V.STRATA + ')')} q ON p.lang = q.lang AND p.gc_bin = q.gc_bin AND p.n = q.n)"
)


@query(f"SELECT 'pair_' || lpad(CAST(number AS VARCHAR), 9, '0') AS pair_id, role, CASE role WHEN 'positive' THEN pos ELSE neg END AS doc_id, lang, gc_bin FROM {_PAIRS}, (SELECT unnest(['positive', 'negative']) AS role)")
def pair_samples(spark, d):
    """Two rows per matched pair: the i-th positive by id and the i-th negative by seeded rank of a stratum; pairs are numbered
    without a task that sees them all."""
    s = V.strata(spark, d).withColumn("sha", S.stable_rank(F.col("doc_id"), 11))
    m = M.match_strata(s.where("label = 1"), s.where("label = 0"), ["lang", "gc_bin"], ["doc_id"], ["sha", "doc_id"])
    m = M.numbered(m.select("lang", "gc_bin", F.col("l_doc_id").alias("pos"), F.col("r_doc_id").alias("neg")), ["lang", "gc_bin"], ["pos"], "number")
    sides = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("doc_id")) for r, c in (("positive", "pos"), ("negative", "neg")))))
    return m.select(F.concat(F.lit("pair_"), F.lpad(F.col("number").cast("string"), 9, "0")).alias("pair_id"), sides.alias("x"), "lang", "gc_bin").select("pair_id", "x.*", "lang", "gc_bin")


_COIN = "CAST('0x' || substr(md5('5:' || epoch || ':' || doc_id), 1, 2) AS INTEGER) % 2 = 1"


@query(f"SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, {_COIN} AS turned, CASE WHEN {_COIN} THEN {_RC.format('seq')} ELSE seq END AS seq FROM {V.DNA}, range(2) t(epoch)")
def augmented_views(spark, d):
    """One view per sequence and epoch, turned by a coin that depends on seed, epoch and id alone."""
    s = V.dna(spark, d).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"), "seq")
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("5"), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))), 1, 2), 16, 10).cast("int") % 2 == 1
    return s.select("doc_id", "epoch", coin.alias("turned"), F.when(coin, S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


# --- motifs ----------------------------------------------------------------------------------------------------------


@query(f"SELECT id, start_bp, list_transform(range(4), lambda i: CAST(start_bp + i AS INTEGER)) AS changed FROM (SELECT id, CAST(start AS INTEGER) AS start_bp FROM {_HITS})")
def disrupted_positions(spark, d):
    s = V.dna(spark, d).select(F.col("doc_id").alias("id"), "seq")
    e = P.disrupt(s.join(A.pwm_best_hits(s, "id", "seq", _PWM), "id"), "seq", _PWM)
    letter = lambda c, i: F.substr(c, i + 1, F.lit(1))
    differ = F.filter(F.sequence(F.col("start"), F.col("start") + 3), lambda i: letter("seq", i) != letter("mutant", i))
    return e.select("id", F.col("start").alias("start_bp"), differ.alias("changed"))


@query(
    f"WITH w AS (SELECT id, start, substr(seq, start + 1, 8) AS k FROM (SELECT doc_id AS id, seq, unnest(range(0, 249)) AS start FROM {V.DNA})), s AS ({_SCAN}), "
    "h AS (SELECT id, start, motif, distance FROM (SELECT *, row_number() OVER (PARTITION BY id, start ORDER BY distance, motif, orientation) AS n FROM s WHERE distance <= 1) WHERE n = 1) "
    "SELECT id, count(*) AS hits, count(*) FILTER (distance = 0) AS exact, '[' || string_agg('[' || start || ',' || (start + 8) || ']', ',' ORDER BY start) || ']' AS spans, "
    "len(list_distinct(flatten(list(range(start, start + 8))))) AS bases FROM h GROUP BY id"
)
def annotated_motifs(spark, d):
    """Sequences with a window within one substitution of a motif: number of windows, exact ones, their spans as JSON, and how many
    bases they cover."""
    h = P.near_motif_scan(V.dna(spark, d), "doc_id", "seq", list(_NEAR), 1)
    g = h.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("distance") == 0).alias("exact"), F.array_sort(F.collect_list(F.array("start", "end"))).alias("at"))
    bases = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t[0], t[1] - 1)))))
    return g.select("id", "hits", "exact", F.to_json("at").alias("spans"), bases.cast("long").alias("bases"))


@query(f"SELECT CAST(quality AS INTEGER) AS label, count(*) AS n, round(avg((round(relative, 9) >= 0.8)::INTEGER), 6) AS at80, round(avg((round(relative, 9) >= 0.85)::INTEGER), 6) AS at85, round(avg((round(relative, 9) >= 0.9)::INTEGER), 6) AS at90 FROM {_HITS} h JOIN labels l ON l.doc_id = h.id // {V.WINDOWS} GROUP BY quality")
def motif_prevalence_by_label(spark, d):
    h = A.pwm_best_hits(V.dna(spark, d), "doc_id", "seq", _PWM).select(F.floor(F.col("id") / V.WINDOWS).alias("doc_id"), rounded("relative", 9).alias("relative"))
    x = h.join(V.read(spark, d, "labels"), "doc_id").groupBy(F.col("quality").cast("int").alias("label"))
    return x.agg(F.count(F.lit(1)).alias("n"), *(rounded(F.avg((F.col("relative") >= t).cast("double"))).alias(f"at{round(100 * t)}") for t in (0.8, 0.85, 0.9)))
