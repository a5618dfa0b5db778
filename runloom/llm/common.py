"""What several operators share: tables, lineage cuts, components."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        found = tempfile.mkdtemp(prefix="runloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; for small or row-numbered frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder as compressed Parquet and read it again; the driver deletes it when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/runloom-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table of one file is otherwise one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def ascii_lower(column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


#: Items of an array that walked() takes at once.
STEP = 128


def walked(items: Column, start: Column, step, emit, kind: str) -> Column:
    """emit(state, item) of each item, an array of `kind`, where step(state, item) makes the next state.

    An array that grows by one item is copied each time, so the walk is in
    blocks: the states at their beginnings first, then each block by itself.
    """
    empty = F.array().cast(f"array<{kind}>")
    block = lambda i: F.slice(items, i * STEP + 1, F.lit(STEP))
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / STEP).cast("int"))
    begun = F.aggregate(
        blocks,
        F.struct(start.alias("state"), F.filter(F.array(start), lambda s: F.lit(False)).alias("all")),
        lambda acc, i: F.struct(F.aggregate(block(i), acc["state"], step).alias("state"), F.concat(acc["all"], F.array(acc["state"])).alias("all")),
        lambda acc: acc["all"],
    )

    def within(state: Column, i: Column) -> Column:
        return F.aggregate(block(i), F.struct(state.alias("state"), empty.alias("all")), lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["all"], F.array(emit(acc["state"], x))).alias("all")), lambda acc: acc["all"])

    return F.flatten(F.transform(begun, within))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id.

    Alternates large-star and small-star steps, so the number of rounds is
    logarithmic in the diameter. Every round is groupings with map-side minima,
    which are stored, and joins of stored frames, which adaptive execution can
    split, so a hub of any degree is spread. Ids without an edge to another id
    are not returned.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now.n:
            break
        mark = now
    else:
        raise RuntimeError("components: no fixed point")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def parts_for(n: int, per_part: int, least: int = 8) -> int:
    """Partitions for n units of work at per_part each."""
    return max(least, math.ceil(n / per_part))
