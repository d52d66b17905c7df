"""Two synchronous hops over the file graph, and the map of what is imported most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import saturate
from codeloom.plans.stage import Stage

IMPORT_OUT, IMPORT_IN, TEST_AFFINITY, TEST_BIAS = 0.6, 0.45, 0.7, 1.25
FRONTIER, HOPS, DECAY, PROP, FLOOR = 64, 2, 0.5, 0.8, 0.05
#: Rows of frontiers that are broadcast at most.
BROADCAST_ROWS = 100_000


def traversal(edges: DataFrame, test_bias: bool = False) -> DataFrame:
    """(src, dst, w): stored edges, and imports backwards, which are never stored."""
    affinity = TEST_AFFINITY * (TEST_BIAS if test_bias else 1.0)
    w = F.when(F.col("kind") == "import_out", IMPORT_OUT).when(F.col("kind") == "test_affinity", affinity).otherwise(F.col("weight"))
    back = edges.filter("kind = 'import_out'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(IMPORT_IN).alias("w"))
    return edges.select("src", "dst", w.alias("w")).unionByName(back)


def _top(scores: DataFrame, col: str) -> DataFrame:
    best = Window.partitionBy("task_id").orderBy(F.desc(col), "path")
    return scores.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= FRONTIER).drop("nth")


def _hop(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, path, prop): contributions are added in the order of their sources and sizes."""
    small = frontier.count() <= BROADCAST_ROWS  # 64 rows a task, of any number of tasks
    reached = (F.broadcast(frontier) if small else frontier).join(edges, F.col("path") == F.col("src"))
    part = reached.select("task_id", F.col("dst").alias("to"), F.struct("path", (F.col("score") * F.col("w") * DECAY).alias("c")).alias("c"))
    fold = F.aggregate(F.array_sort(F.collect_list("c")), F.lit(0.0), lambda a, b: a + b["c"])
    return part.groupBy("task_id", "to").agg(fold.alias("prop")).withColumnRenamed("to", "path")


def walk(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, path, seed, prop, total) from seeds (task_id, path, seed) and edges (src, dst, w).

    Edges, seeds and frontiers are stored once, as each is read several times. The first frontier is the 64 best seeds of a task, the next the 64 best newly reached files.
    """
    stage = Stage(seeds.sparkSession)
    seeds, edges = stage.keep(seeds.select("task_id", "path", "seed"), "seeds"), stage.keep(edges.select("src", "dst", "w"), "edges")
    first = stage.keep(_top(seeds.filter(F.col("seed") >= FLOOR).select("task_id", "path", F.col("seed").alias("score")), "score"), "first")
    one = stage.keep(_hop(first, edges), "one")
    fresh = one.join(first, ["task_id", "path"], "left_anti")
    second = stage.keep(_top(fresh.select("task_id", "path", F.col("prop").alias("score")), "score"), "second")
    two = _hop(second, edges)
    prop = one.withColumnRenamed("prop", "p1").join(two.withColumnRenamed("prop", "p2"), ["task_id", "path"], "full")
    prop = prop.select("task_id", "path", (F.coalesce("p1", F.lit(0.0)) + F.coalesce("p2", F.lit(0.0))).alias("prop"))
    both = seeds.select("task_id", "path", "seed").join(prop, ["task_id", "path"], "full").fillna(0.0, ["seed", "prop"])
    return both.withColumn("total", saturate(F.col("seed") + F.lit(PROP) * F.col("prop")))


def import_degree(edges: DataFrame) -> DataFrame:
    """(path, degree): map mode's order, by how many files import a file, then by path."""
    return edges.filter("kind = 'import_out'").groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "path")
