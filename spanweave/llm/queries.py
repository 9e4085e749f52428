"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORACLES: dict[str, str] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    classes = jaccard_classes(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return classes.select("doc_id", "n_shingles", "component_id")


ORACLES["op2_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON r.c = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back, records_of_rows

    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("completion"))).alias("record"))
    records = records_of_rows(table(spark, sf_dir, "conversations")).select(F.col("conv_id").cast("long").alias("conv_id"), "record").union(own)
    back = read_back(format_chats(records, ["conv_id"]), ["conv_id"])
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op4_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + 4
      + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) END) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c
"""


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The rules of op9's contract, in its order and words.
OP9_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .links import judge_pages

    return judge_pages(table(spark, sf_dir, "pages"), rules=OP9_RULES)


def op1_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, pii_digests

    return pii_digests(find_pii(table(spark, sf_dir, "documents")))


def op6_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, secret_digests

    return secret_digests(find_secrets(table(spark, sf_dir, "documents")))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import calibrated

    return calibrated(table(spark, sf_dir, "documents"))


def op7_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLES["op7_voronoi_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import multi_index_search

    return multi_index_search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """Rounds written out one after the other: a<i> assigns, c<i> moves the centroids."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS INTEGER) AS k, e AS c FROM v QUALIFY k < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, e, k, d FROM (
  SELECT r, vec_id, e, k, CAST(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}
) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m
  FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY k, p) GROUP BY k
) USING (k))"""
            )
    return (
        ", ".join(steps)
        + f""" SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""
    )


ORACLES["op11_centroid_clusters"] = _lloyd_sql()


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM d WHERE len(ws) >= 35),
h AS MATERIALIZED (SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM w),
t AS (SELECT r, p FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
c AS MATERIALIZED (SELECT DISTINCT r, p + k AS i FROM t, range(35) x(k)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws[i:i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) x(m) WHERE len(ws) >= m)),
f AS MATERIALIZED (SELECT lang, ph, m, count(*) AS f FROM g GROUP BY lang, ph, m HAVING count(*) >= 100),
c AS (SELECT lang, ph, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.ph, c.m, a, k, x.f AS l, y.f AS r, n, CAST((1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:c.m] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
i AS (SELECT lang, ph[j:j + q - 1] AS ph, max(f) AS inside FROM (SELECT lang, ph, f, q, unnest(range(1, m - q + 2)) AS j FROM f, range(2, 5) x(q) WHERE m > q) GROUP BY 1, 2),
o AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.ph = b.ph WHERE inside IS NULL OR 100 * inside < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
