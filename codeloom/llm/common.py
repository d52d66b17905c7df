"""Shared helpers: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests in local mode) a
    temporary folder of this machine is made and set for the session.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and lets several
    consumers read the result without computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, u: str, v: str, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: undirected pairs of any type with an order in columns ``u`` and ``v``; loops, repeats and null
    ends are ignored. Returns (node, root), root the smallest node of the component, one
    row for each node that has an edge and is not a root itself. Only minima per
    node are aggregated (combined before the shuffle), no neighbour list is ever gathered;
    each round is written to the shared folder.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a > b").distinct()
    e = materialize(e, "edges")
    stamp = _stamp(e)
    if not stamp[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(low)
        e = materialize(small.distinct(), "small")
        before, stamp = stamp, _stamp(e)
        if before == stamp:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
