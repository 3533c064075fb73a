"""Helpers shared by the corpus operators: columns, the shared folder, written tables, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows dealt out where it has fewer splits than there are cores (a small file of one row group)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the aliases given, whatever else the table holds.

    Columns are found by exact name first and otherwise without regard to case, so further columns with
    clashing names (``Text`` beside ``text``, or one named as an output column) do no harm.
    """
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{place_of(df, name)}").alias(alias) for alias, name in wanted.items()])


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column: that of exactly the name, else the first of the name in another case."""
    names = df.columns
    for found in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        at = next((i for i, c in enumerate(names) if found(c)), None)
        if at is not None:
            return at
    raise ValueError(f"no column {name!r} in {names}")


def trim() -> None:
    """Freed memory goes back to the system, as far as the allocators can give it."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give:
        give(0)


def give_back() -> None:
    """The same on the driver after a fit, cycles included: what it keeps counts in all later stages."""
    gc.collect()
    trim()


def tidy(function):
    """An Arrow function that gives freed memory back to the system as its task ends: a worker goes on to other tasks,
    and what its allocators keep would count against the executor all along."""

    @wraps(function)
    def run(batches):
        yield from function(batches)
        trim()

    return run


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most so many bytes in this session, unless it has been told otherwise: a job of many stages
    keeps its workers, and what batches of 64 MB of text take up stays with them and the executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64mb"):
        spark.conf.set(key, size)


def kept_rows(df: DataFrame, function) -> DataFrame:
    """df.mapInArrow for a function that only leaves rows out, whatever the columns' names: they may clash."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.mapInArrow(tidy(function), flat.schema).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs in one
    process, a temporary one; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veldra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veldra-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended; the folder is then the cluster's to clean
            pass


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veldra_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_veldra_path", None)
    if path:
        drop_path(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go now: Spark deletes them only once the driver's JVM has collected
    what did, which may be long after their last reader."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_sample(df: DataFrame, key: Column, n: int, total: int | None = None, spare: int = 8) -> DataFrame:
    """At most n distinct rows, those of the smallest hashes of their key: bounded, and the same at every run.

    With the number of rows that df is drawn from, hashes are first held to a share of their range in which `spare`
    times as many rows as wanted are expected, so that tasks don't each give off n rows. Where df is so small a part
    of them that fewer than n rows come back, all hashes are looked at: the sample is the same with and without.
    """
    hashed = df.withColumn("_h", F.xxhash64(key, F.lit(7)))
    if total and total > spare * n:
        share = hashed.where(F.col("_h") < int(spare * n / total * 2**64) - 2**63)
        rows = share.distinct().orderBy("_h", key).limit(n).drop("_h").collect()
        if len(rows) == n:
            return df.sparkSession.createDataFrame(rows, df.schema)
    return hashed.distinct().orderBy("_h", key).limit(n).drop("_h")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: one row (node, root) for each node that has an edge; root is the
    smallest node of the component.

    Alternates large-star and small-star steps, which converge in about log2 of the longest path. Each round is
    written to the shared folder, so that lineage stays short. Neighbours are reduced by min() before they are
    joined, so that no group is gathered in one task. Rounds beyond `rounds` are an error: 60 are enough for paths of
    any length that a table can hold.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    sign = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))]  # of distinct rows
    last = e.agg(*sign).first()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        small = small.select("x.*").where("u <> v").distinct()
        nxt = materialize(small, "edges")
        now = nxt.agg(*sign).first()
        discard(e)
        e = nxt
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    free_shuffles(edges.sparkSession)  # the rounds' own, and what they left in the driver
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("node")).distinct().join(stars.select(F.col("u").alias("node")), "node", "left_anti")
    return stars.select(F.col("u").alias("node"), "root").unionByName(roots.select("node", F.col("node").alias("root")))
