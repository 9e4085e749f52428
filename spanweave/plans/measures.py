"""Registered queries: exact signed-rank tails, localisation on intervals, greedy picks, audits of two references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import audit as D
from ..operators import matching as M
from ..operators import stats as T
from . import fixtures as V
from .registry import query, rounded

# Groups of at most ten differences, with ties and zeros among them; the SQL goes through all sign choices.
_SMALL = f"(SELECT model_id, seed, sample_id // 10 AS part, round(p_forward - p_rc, 2) AS x FROM {V.PREDICTIONS})"
_RANKED = (
    f"(SELECT model_id, seed, part, x > 0 AS up, row_number() OVER (PARTITION BY model_id, seed, part ORDER BY abs(x), x) - 1 AS bit, "
    f"rank() OVER (PARTITION BY model_id, seed, part ORDER BY abs(x)) + (count(*) OVER (PARTITION BY model_id, seed, part, abs(x)) - 1) / 2.0::DOUBLE AS r FROM {_SMALL} WHERE x <> 0)"
)


@query(f"WITH k AS MATERIALIZED {_RANKED}, w AS (SELECT model_id, seed, part, count(*) AS n, coalesce(sum(r) FILTER (up), 0.0) AS w_plus FROM k GROUP BY ALL), "
       f"s AS (SELECT w.model_id, w.seed, w.part, n, w_plus, mask, (SELECT coalesce(sum(r), 0.0) FROM k WHERE k.model_id = w.model_id AND k.seed = w.seed AND k.part = w.part AND (mask >> bit) % 2 = 1) AS v FROM (SELECT *, unnest(range(0, 1 << n)) AS mask FROM w) w), "
       f"p AS (SELECT model_id, seed, part, avg(CASE WHEN v >= w_plus THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM s GROUP BY ALL), "
       f"h AS (SELECT model_id, seed, part, count(*) AS held FROM {_SMALL} GROUP BY ALL) "
       f"SELECT model_id, seed, CAST(part AS BIGINT) AS part, coalesce(n, 0) AS n, round(coalesce(w_plus, 0.0), 6)::DOUBLE AS w_plus, CASE WHEN held >= 2 THEN round(p, 9) END AS p FROM h LEFT JOIN w USING (model_id, seed, part) LEFT JOIN p USING (model_id, seed, part)")
def signed_rank_exact(spark, d):
    x = V.predictions(spark, d).select("model_id", "seed", F.floor(F.col("sample_id") / 10).alias("part"), F.round(F.col("p_forward") - F.col("p_rc"), 2).alias("x"))
    return T.signed_rank_test(x, ["model_id", "seed", "part"], "x").select("model_id", "seed", "part", "n", rounded("w_plus").alias("w_plus"), rounded("p", 9).alias("p"))


# --- localisation ----------------------------------------------------------------------------------------------------

# Two intervals that may overlap; rows whose id is a multiple of 11 have none. Values are rounded so that some are equal.
_AT = "i - 1 >= sample_id % 50 AND i - 1 < sample_id % 50 + 8 OR i - 1 >= sample_id % 23 + 20 AND i - 1 < sample_id % 23 + 25"
_LONG = f"(SELECT sample_id, i, round(fwd[i], 1) + 0.0 AS v, CAST(sample_id % 11 <> 0 AND ({_AT}) AS INTEGER) AS m FROM {V.ATTRIBUTIONS}, range(1, 65) t(i))"


@query(f"WITH l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, i) AS n, sum(m) OVER (PARTITION BY sample_id) AS inside FROM {_LONG}), "
       "t AS (SELECT sample_id, v, any_value(inside) AS inside, sum(m) AS hit, sum(sum(m)) OVER (PARTITION BY sample_id ORDER BY v DESC) AS tp, sum(count(*)) OVER (PARTITION BY sample_id ORDER BY v DESC) AS seen FROM l GROUP BY sample_id, v), "
       "p AS (SELECT sample_id, sum(hit * tp / seen::DOUBLE) / any_value(inside) AS precision FROM t WHERE inside > 0 GROUP BY sample_id), "
       "o AS (SELECT sample_id, any_value(inside) AS inside, avg(m::DOUBLE) FILTER (n <= 8) AS top_overlap, sum(abs(v)) FILTER (m = 1) / sum(abs(v)) AS mass, avg(v) FILTER (m = 1) - avg(v) FILTER (m = 0) AS gap FROM l GROUP BY sample_id) "
       "SELECT sample_id, CASE WHEN inside > 0 THEN top_overlap END AS top_overlap, CASE WHEN inside > 0 THEN round(mass, 9) END AS mass, CASE WHEN inside > 0 THEN round(gap, 9) + 0.0 END AS gap, round(precision, 9) AS precision FROM o LEFT JOIN p USING (sample_id)")
def interval_localisation(spark, d):
    span = lambda start, n: F.struct(start.cast("long").alias("start"), (start + n).cast("long").alias("end"))
    i = F.col("sample_id")
    spans = F.when(i % 11 != 0, F.array(span(i % 50, 8), span(i % 23 + 20, 5))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    found = A.interval_localisation(F.transform("fwd", lambda x: F.round(x, 1) + 0.0), spans, 8)
    return V.attributions(spark, d).select("sample_id", *((c if n == "top_overlap" else rounded(c, 9) + 0.0).alias(n) for n, c in found.items()))


# --- picks -----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE f AS (SELECT lang, source, min(n_chars * 1000000 + doc_id % 1000000) AS o FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), c AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i FROM (SELECT DISTINCT lang FROM f)), "
       "g(i, taken, lang, source) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR UNION ALL SELECT i, CASE WHEN s IS NULL THEN taken ELSE list_append(taken, s) END, lang, s FROM (SELECT c.i, g.taken, c.lang, (SELECT arg_min(source, o) FROM f WHERE f.lang = c.lang AND NOT list_contains(g.taken, f.source)) AS s FROM g JOIN c ON c.i = g.i + 1)) "
       "SELECT lang, source FROM g WHERE source IS NOT NULL")
def greedy_source_per_lang(spark, d):
    """Each language in turn takes the source of its shortest document that none before it has taken."""
    o = F.col("n_chars") * 1_000_000 + F.col("doc_id") % 1_000_000
    return M.greedy_picks(V.read(spark, d, "documents").select("lang", "source", o.alias("o")), "lang", ["source"], ["o"])


# --- audits ----------------------------------------------------------------------------------------------------------


def _references(spark, d):
    """A reference of the documents' sequences, and a copy with planted changes: some letters, a lost tail, lost and new ones."""
    x = V.dna(spark, d).select(F.col("doc").alias("component"), (F.col("doc_id") % V.WINDOWS).alias("chunk"), "seq")
    odd = (F.col("component") % 10 == 3) & (F.col("chunk") % 5 == 2)
    seq = F.when(odd, F.overlay("seq", F.translate(F.substr("seq", F.lit(101), F.lit(2)), "ACGT", "CGTA"), F.lit(101))).when((F.col("component") % 10 == 4) & (F.col("chunk") == 1), F.left("seq", F.lit(200))).otherwise(F.col("seq"))
    copy = x.where("component % 10 <> 5").select("component", "chunk", seq.alias("seq"))
    return x.where("component % 10 <> 6"), copy


_REFERENCE = f"(SELECT doc AS component, doc_id % {V.WINDOWS} AS chunk, seq FROM {V.DNA} WHERE doc % 10 <> 6)"
_COPY = (
    f"(SELECT doc AS component, doc_id % {V.WINDOWS} AS chunk, CASE WHEN doc % 10 = 3 AND doc_id % {V.WINDOWS} % 5 = 2 THEN substr(seq, 1, 100) || translate(substr(seq, 101, 2), 'ACGT', 'CGTA') || substr(seq, 103) "
    f"WHEN doc % 10 = 4 AND doc_id % {V.WINDOWS} = 1 THEN substr(seq, 1, 200) ELSE seq END AS seq FROM {V.DNA} WHERE doc % 10 <> 5)"
)
_WHOLE = "(SELECT component, string_agg(seq, '' ORDER BY chunk) AS s FROM {} GROUP BY component)"


@query(f"SELECT component, length(a.s) AS left_letters, length(b.s) AS right_letters, CASE WHEN b.s IS NULL THEN 'left only' WHEN a.s IS NULL THEN 'right only' WHEN a.s = b.s THEN 'same' WHEN length(a.s) <> length(b.s) THEN 'length' ELSE 'letters' END AS verdict FROM {_WHOLE.format(_REFERENCE)} a FULL JOIN {_WHOLE.format(_COPY)} b USING (component)")
def reference_audit(spark, d):
    return D.audit_components(*_references(spark, d), fan=4)


@query(f"SELECT component, chunk, list_min(p) - 1 AS first_difference, len(p) AS differing FROM (SELECT component, chunk, list_filter(range(1, 257), lambda i: substr(a.seq, i, 1) <> substr(b.seq, i, 1)) AS p FROM {_REFERENCE} a JOIN {_COPY} b USING (component, chunk) WHERE a.seq <> b.seq)")
def reference_differences(spark, d):
    return D.differing_chunks(*_references(spark, d), fan=4)
