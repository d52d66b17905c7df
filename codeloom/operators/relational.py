"""Relational building blocks of the index: preferences, diffs, merges, containment, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import ancestors

CANDIDATE_CAP = 256


def longest_prefix(paths: DataFrame, path_col: str, owners: DataFrame, dir_col: str) -> DataFrame:
    """Each path with the longest owner directory that is the path or above it; an equi-join on exploded ancestors."""
    up = paths.select(path_col, F.explode(ancestors(F.col(path_col))).alias("_dir")).distinct()
    hit = up.join(owners.select(F.col(dir_col).alias("_dir")).distinct(), "_dir")
    return hit.groupBy(path_col).agg(F.max_by("_dir", F.length("_dir")).alias("owner"))


def importable(packages: DataFrame) -> DataFrame:
    """(dir, name): the package that an import of a directory means: no test package, rather not main, then the least name."""
    real = packages.filter(~F.col("name").endswith("_test") & (F.col("name") != ""))
    return real.groupBy("dir").agg(F.min(F.struct((F.col("name") == "main").alias("main"), "name")).alias("best")).select("dir", F.col("best.name").alias("name"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def classify(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): added, deleted, modified or unchanged; two nulls are equal."""
    a = old.select(key, F.col(mark).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(mark).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def cascade(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the deleted."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(*keys), keys, "left_anti")


def unique_match(left: DataFrame, right: DataFrame, on: str, key: list[str], target: str) -> DataFrame:
    """(key, n, target): the one match of each left row, null where there is none or several."""
    sizes = right.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("_one"))
    hit = left.join(sizes, on, "left")
    return hit.select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("_one")).alias(target))


def capped_candidates(left: DataFrame, right: DataFrame, on: str, key: list[str], cap: int = CANDIDATE_CAP) -> DataFrame:
    """(key, n, outcome): bound, or no_candidate for none and for more than the cap."""
    sizes = right.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return left.join(sizes, on, "left").select(*key, n.alias("n"), F.when((n > 0) & (n <= cap), "bound").otherwise("no_candidate").alias("outcome"))


def enclosing(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, label: str) -> DataFrame:
    """Each point with the last span that starts at or before it, if that span ends at or after it; by a window over both, not a range join."""
    a = spans.select(by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(end).alias("end"), F.col(label).alias("label")).alias("_span"), F.lit(None).cast(points.schema[at].dataType).alias(at))
    rest = [c for c in points.columns if c not in (by, at)]
    b = points.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_span"].dataType).alias("_span"), at, *rest)
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_last", last).filter("_side = 1")
    return found.select(by, at, *rest, F.when(F.col("_last.end") >= F.col(at), F.col("_last.label")).alias("container"))


def running(rows: DataFrame, cost: str, order: list[Column | str], part: list[str]) -> DataFrame:
    """Adds running: the sum of costs so far."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w))


def stride(rows: DataFrame, order: list[str], every: int, part: list[str]) -> DataFrame:
    """Every k-th row of each part in order."""
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") % every == 0)


def snapshot_id(rows: DataFrame, key: Column, mark: Column, buckets: int = 256) -> DataFrame:
    """One row: the hash of all keys and marks in key order.

    Keys are cut into ranges by their first bytes' bucket, each hashed on its own, and the ranges' hashes are hashed
    in order, so that no task gathers all rows.
    """
    each = rows.select(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int").alias("b"), F.struct(key.cast("string").alias("k"), F.coalesce(mark.cast("string"), F.lit("<none>")).alias("m")).alias("r"))
    flat = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws("\t", r["k"], r["m"])))
    parts = each.groupBy("b").agg(F.sha2(flat, 256).alias("h"))
    return parts.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"])), 256).alias("snapshot_id"))
