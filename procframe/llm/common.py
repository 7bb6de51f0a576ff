"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: they bound a Python worker's memory, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Spark's own setting to drop the shuffle files of a query as it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; without it there is none that a cluster could use."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if spark.sparkContext.master.startswith("local"):  # one machine, as in tests: any folder is shared
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/procframe-checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option for the queries within, and what it was after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and survives lost executors.

    The shuffle files of the write go as it ends. The files stay, for the owner of the folder to clear.
    """
    path = f"{shared_dir(df.sparkSession)}/procframe-{uuid.uuid4().hex}/{name}"
    with setting(df.sparkSession, CLEAN, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that long texts don't pile up in a Python worker.

    The options stay set, as returned DataFrames run later.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_rank(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int | Column) -> DataFrame:
    """Number the rows of each group 0, 1, ... without bringing a group into one task.

    Rows go to buckets by a hash of `order`; a bucket starts where the ones before it end. Ties in `order` (repeated
    rows) get numbers in any order, gapless all the same. `df` must give the same rows when read twice.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int"))
    keys = [*group, "__bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys).orderBy(*order)
    joined = dealt.join(starts, keys)
    return joined.withColumn(out, (F.col("__start") + F.row_number().over(within) - 1).cast("long")).drop("__bucket", "__start")


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if it has no more than `limit` rows, else df, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with their group's row of `groups`, which has the number of its rows in `size`; `total` is that of all rows.

    Groups of over an eighth of a task's fair share of rows come by broadcast, so that none is gathered: there are at most
    eight times as many of them as shuffle partitions. Both frames must be cheap to read twice.
    """
    least = max(64, total // (8 * shuffle_partitions(rows.sparkSession)))
    hot = groups.where(F.col(size) > least)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= least), key)
    return few.unionByName(rows.join(F.broadcast(hot), key))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of one orderable type: (node, root), root the least node reachable.

    Alternating large-star and small-star steps; each step is a min-aggregate and an equi-join, so no neighbour list is
    ever gathered, and each round's edges are written to the shared folder. Nodes without an edge aren't returned.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = materialise(plain, "edges")
    seen = None
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
        own = least.select(F.col("m").alias("a"), F.col("v").alias("b"))
        now = materialise(linked.union(own).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def crc32_utf8(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
