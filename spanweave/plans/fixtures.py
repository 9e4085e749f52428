"""Views over the driver's tables that stand for sequences, peaks, predictions and attributions; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_bin

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26] * 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Windows of a document are numbered below this.
WINDOWS = 1 << 20


def tiles(s: Column, width: int) -> Column:
    """Array of the consecutive pieces of `width` letters of a text of letters A to Z, the last one ending where the text ends
    (so it shares letters with the one before, unless the length is a multiple). One pass over the text: the pieces are
    cut by one pattern, and only the last one is put together from two. Shorter texts have none."""
    pieces = F.regexp_extract_all(s, F.lit(f"[A-Z]{{1,{width}}}"), F.lit(0))
    last = lambda p, i: F.concat(F.substr(F.get(pieces, i - 1), F.length(p) + 1), p)
    whole = F.transform(pieces, lambda p, i: F.when(F.length(p) < width, last(p, i)).otherwise(p))
    return F.when(F.length(s) >= width, whole).otherwise(F.array().cast("array<string>"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 256 letters that tile every text, the last one ending where the text ends (a text of fewer letters holds
    none); doc_id is the sequence's own id, doc the document's."""
    s = F.translate(F.regexp_replace("text", "[^A-Za-z]+", ""), _LETTERS, _BASES)
    whole = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source", s.alias("s"))
    cut = whole.select("doc", "lang", "source", F.posexplode(tiles(F.col("s"), 256)).alias("w", "seq"))
    return cut.select((F.col("doc") * WINDOWS + F.col("w")).alias("doc_id"), "doc", "lang", "source", "seq")


_WHOLE = f"(SELECT *, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS s FROM documents)"
_TILES = f"(SELECT *, unnest(range(0, CAST(ceil(length(s) / 256) AS BIGINT))) AS w FROM {_WHOLE} WHERE length(s) >= 256)"
DNA = f"(SELECT doc_id * {WINDOWS} + w AS doc_id, doc_id AS doc, lang, source, substr(s, least(256 * w, length(s) - 256) + 1, 256) AS seq FROM {_TILES})"


def peaks(spark: SparkSession, sf_dir: str, span: int = 20_000_000) -> DataFrame:
    p = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("chr"), (1 + F.col("o_custkey") % 22).cast("string")).alias("chrom"),
        ((F.col("o_orderkey").cast("long") * 7919) % span + 1000).alias("summit"), F.col("o_totalprice").cast("double").alias("signal"), (F.col("o_orderkey") % 1000).cast("double").alias("score"),
    )
    return p.withColumns({"start_bp": F.col("summit") - 128, "end_bp": F.col("summit") + 128})


def peaks_sql(span: int = 20_000_000) -> str:
    return f"(SELECT CAST(o_orderkey AS BIGINT) AS id, 'chr' || (1 + o_custkey % 22) AS chrom, (CAST(o_orderkey AS BIGINT) * 7919) % {span} + 1000 AS summit, (CAST(o_orderkey AS BIGINT) * 7919) % {span} + 872 AS start_bp, (CAST(o_orderkey AS BIGINT) * 7919) % {span} + 1128 AS end_bp, CAST(o_totalprice AS DOUBLE) AS signal, CAST(o_orderkey % 1000 AS DOUBLE) AS score FROM orders)"


def accessible(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_orderkey").cast("long") * 104729 + F.col("l_partkey").cast("long") * 15485863 + F.col("l_linenumber").cast("long") * 32452843) % 20_000_000
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 22).cast("string")).alias("chrom"), start.alias("start_bp"), (start + 10 * F.col("l_quantity").cast("long")).alias("end_bp"), F.col("l_extendedprice").cast("double").alias("signal"))


ACCESSIBLE = "(SELECT 'chr' || (1 + l_suppkey % 22) AS chrom, s AS start_bp, s + 10 * CAST(l_quantity AS BIGINT) AS end_bp, CAST(l_extendedprice AS DOUBLE) AS signal FROM (SELECT *, (CAST(l_orderkey AS BIGINT) * 104729 + CAST(l_partkey AS BIGINT) * 15485863 + CAST(l_linenumber AS BIGINT) * 32452843) % 20000000 AS s FROM lineitem))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").cast("int").alias("label"), ((F.col("n_chars") % 997).cast("double") / F.lit(997.0)).alias("score"))


SCORED = "(SELECT doc_id, lang, CAST(quality AS INTEGER) AS label, CAST(n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    m, s = F.floor(F.col("i") / 3).cast("int"), (F.col("i") % 3).cast("int")
    at = (7 * m + 3 * s) % 64
    p = lambda i: F.round(1 / (1 + F.exp(-4 * F.get("embedding", i).cast("double"))), 9)
    return e.select((F.col("vec_id") % 3).cast("int").alias("fold_id"), m.alias("model_id"), s.alias("seed"), F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), p(at).alias("p_forward"), F.when(m == 2, p(at)).otherwise(p(63 - at)).alias("p_rc"))


_P = "round(1 / (1 + exp(-4 * CAST(embedding[{}] AS DOUBLE))), 9)"
PREDICTIONS = f"(SELECT CAST(vec_id % 3 AS INTEGER) AS fold_id, CAST(m AS INTEGER) AS model_id, CAST(s AS INTEGER) AS seed, vec_id AS sample_id, CAST(label >= 5 AS INTEGER) AS label, {_P.format('(7 * m + 3 * s) % 64 + 1')} AS p_forward, CASE WHEN m = 2 THEN {_P.format('(7 * m + 3 * s) % 64 + 1')} ELSE {_P.format('64 - (7 * m + 3 * s) % 64')} END AS p_rc FROM embeddings, range(3) a(m), range(3) b(s))"


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), e.alias("fwd"), F.reverse(e).alias("rc"))


ATTRIBUTIONS = "(SELECT vec_id AS sample_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS fwd, list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS rc FROM embeddings)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc")
    return dna(spark, sf_dir).join(marked, "doc").select("doc_id", "lang", gc_bin(F.col("seq")).alias("gc_bin"), F.col("quality").cast("int").alias("label"))


_GC = "CAST(length(seq) - length(translate(seq, 'GC', '')) AS DOUBLE) / length(seq)"
GC_BIN = f"CAST(least(49, floor({_GC} / CAST(0.02 AS DOUBLE))) AS INTEGER)"
GC = _GC
STRATA = f"(SELECT t.doc_id, lang, {GC_BIN} AS gc_bin, CAST(quality AS INTEGER) AS label FROM {DNA} t JOIN labels l ON t.doc = l.doc_id)"
