"""URL filter: host and path rules, and for all other pages trust and distrust carried along host links.

Personalised PageRank from trusted hosts runs along host edges; distrust from blocked hosts runs along the reversed
edges (a host that links to blocked hosts is suspect). A host is blocked when its distrust exceeds its trust: both sum to
1 over all hosts, so the verdict does not depend on how many there are.
Edges are the absolute links of pages between hosts and, with the small weight PARENT, the step from a host to its parent domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: (verdict, host, path): a rule fits the host and its subdomains if the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Weight of the step from a host to its parent domain; a link of a page weighs 1.
PARENT = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives ''."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, nulls if none fits."""
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("rule"), none.alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank, one per kind: edges (kind, src, dst, w), seeds (kind, host, seed >= 0) -> (kind, host, rank).

    A hub's edges may fill a shuffle partition many times over: the joins by host have one row per host on the other side
    and a sum after them, so the adaptive skew join deals such a partition to many tasks.

    Weights are shared out by src. Mass at hosts without outgoing edges returns to the seeds: it is left out in the
    rounds and the ranks of a kind are scaled to a sum of 1 at the end, which comes to the same. A round is one join by
    source and one sum by target with map-side combining. Ends when four rounds change less than `tolerance` of the ranks'
    sum, as they do at last because a round shrinks the change by `damping`, or after `rounds` if given. Hosts that no
    mass reaches have no row; no seeds: no rows.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    share = cut(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(damping) * F.col("w") / F.col("out")).alias("share")), "share")
    base = cut(seeds.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("part")), "seeds")
    rank = last = seeds.select("kind", "host", F.col("seed").alias("rank"))
    zero, i = F.lit(0.0), 0
    while rounds is None or i < rounds:
        i += 1
        moved = share.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("part"))
        if i % 4:
            rank = moved.union(base).groupBy("kind", "host").agg(F.sum("part").alias("rank"))
            continue
        # A plan of a few rounds, not of all; the ranks of the last plan come along for the change since then.
        parts = moved.union(base).withColumn("old", zero).union(last.select("kind", "host", zero.alias("part"), F.col("rank").alias("old")))
        both = cut(parts.groupBy("kind", "host").agg(F.sum("part").alias("rank"), F.sum("old").alias("old")), "rank")
        rank = last = both.select("kind", "host", "rank")
        total, change = both.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        if not total or change < tolerance * total:
            break
    total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))  # a row per kind
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


@tidy
def judge_pages(pages: DataFrame, rules=RULES, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: the longest fitting rule decides, else the link graph.

    Seeds are the hosts with pages that an allow (trust) or block rule (distrust) fits, by their shares of such pages.
    A page without a host gets verdict allow, like hosts that no mass reaches. Null html has no links. Repeated rows
    are judged alike and kept. Empty table: no rows.
    """
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    p = p.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    linked = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""href\s*=\s*["'](?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), 1)
    to = p.where("host <> ''").select(F.col("host").alias("src"), F.explode(linked).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    by_host = cut(p.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.sum(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked")), "by_host")
    to = cut(to.where("src <> dst"), "to")
    known = by_host.select("host").union(to.select(F.col("dst").alias("host"))).distinct()
    parts = F.split("host", r"\.")
    up = known.select("host", F.posexplode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)))).alias("i", "x"), parts.alias("parts")).where("size(parts) > 2")
    step = lambda n: F.array_join(F.slice("parts", n, F.size("parts")), ".")
    up = up.select(step(F.col("x")).alias("src"), step(F.col("x") + 1).alias("dst")).distinct()
    edges = cut(to.union(up.withColumn("w", F.lit(PARENT))).groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
    # Trust runs along the edges, distrust along the reversed edges.
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "w"))
    seed = lambda kind, c: by_host.where(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", F.col(c).alias("n"))
    seeds = seed("trust", "allowed").union(seed("distrust", "blocked"))
    seeds = seeds.join(F.broadcast(seeds.groupBy("kind").agg(F.sum("n").alias("all"))), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    ranks = cut(spread(ways, seeds, rounds=rounds).groupBy("host").agg(of("trust"), of("distrust")), "ranks")
    bad = F.col("distrust") > F.col("trust")
    return p.drop("html").join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
