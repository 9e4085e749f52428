"""Helpers shared by the corpus operators: shared-folder tables and connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's Parquet table `name` under `sf_dir` (any URI that Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one only where that is unset and
    all run on this machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_spanweave_dir", None):
        sc._spanweave_dir = "file://" + tempfile.mkdtemp(prefix="spark-spanweave-")
    return sc._spanweave_dir


#: Tables in the shared folder that this driver has written and not deleted.
_written: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that `cut` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`operator`, but the tables that it wrote to the shared folder and that its result does not read are deleted."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        before = set(_written)
        out = operator(*args, **kwargs)
        new = [path for path in _written if path not in before]
        read = {name.rsplit("/", 2)[-2] for name in out.inputFiles()} if new else set()
        for path in new:
            if path.rsplit("/", 1)[-1] not in read:
                delete(out.sparkSession, path)
        return out

    return run


#: What holds memory in this Python worker beyond a task, by operator.
_caches: dict[str, Callable[[], object]] = {}


def claim(operator: str, clear: Callable[[], object]) -> None:
    """Called in a Python worker by the operator that runs there: what other operators have left there is freed, so that
    a worker that serves one stage after another holds the caches of one operator only. `clear` frees this one's."""
    for other in [x for x in _caches if x != operator]:
        _caches.pop(other)()
    _caches[operator] = clear


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, every executor sees the files, and
    a lost executor costs only the tasks that read them. Unlike checkpoint(), the plan runs once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanweave_path = path
    return out


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges` (a, b: long) -> (id, component): the smallest id reachable, for every id on an edge.

    Alternates the large-star and small-star steps: each is one aggregation by node with map-side combining and one
    join, so a node with many neighbours is never gathered in one task. Every round is written to the shared folder.
    Stops when a round changes nothing; a round halves path lengths, so `rounds` are never met in practice (an error).
    An empty edge table gives an empty result; self-loops and repeated edges are harmless.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        e = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(e.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("id"), "component").union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def bucketed(df: DataFrame, key: str, name: str = "part") -> DataFrame:
    """`df` written to the shared folder in as many buckets of `key` as there are shuffle partitions, and read back: grouping
    or joining it by `key` moves no row again. Each task writes one file per bucket that it has rows of, so `key` should
    take few values in a task. `drop_bucketed` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    table_name = f"{name}_{path[-32:]}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table_name)
    _bucketed[table_name] = path
    _written.append(path)
    out = spark.table(table_name)
    out._spanweave_bucketed = table_name
    return out


#: Catalog names of the tables that `bucketed` has written, and their folders.
_bucketed: dict[str, str] = {}


def drop_bucketed(df: DataFrame) -> None:
    """Remove a table that `bucketed` returned."""
    name = df._spanweave_bucketed
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete(df.sparkSession, _bucketed.pop(name))
