"""From a task to a plan of files and levels over a finished index: seeds, walk, levels, fit."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import extension_of
from codeloom.operators import levels, seed, task, walk
from codeloom.plans.store import Index

CONFIG, DATA = ("yaml", "yml", "toml", "ini", "cfg", "env"), ("sql", "json", "csv")


@dataclass
class Plan:
    task: str
    budget: int
    snapshot_id: str
    mode: str
    rows: list[dict] = field(default_factory=list)
    excluded: int = 0  # files that no level reached, which are not in rows


def role(path: Column) -> Column:
    ext = extension_of(path)
    return F.when(ext.isin(*CONFIG), "config").when(ext.isin(*DATA), "data").otherwise("code")


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def seeds_of(index: Index, parsed: dict, forced: list[str]) -> DataFrame:
    """(task_id, path, signal, score) of one task; forced files match shell patterns."""
    spark, files, symbols = index.spark, index.read("files"), index.read("symbols")
    terms = spark.createDataFrame([("task", t["lower"], t["originals"]) for t in parsed["terms"]], "task_id string, term string, originals array<string>")
    parts = [seed.file_names(files, terms)]
    for signal, df in (("S1", seed.exact_names(symbols, terms)), ("S4", seed.bm25_names(symbols, terms))):
        parts.append(df.select("task_id", "path", F.lit(signal).alias("signal"), "score"))
    docs = symbols.groupBy("path").agg(F.concat_ws("\n", F.array_sort(F.collect_list("doc"))).alias("docs")).withColumn("content", F.lit(""))
    union = parts[0]
    for df in parts[1:]:
        union = union.unionByName(df)
    ranked = union.groupBy("task_id", "path").agg(F.sum("score").alias("score"))
    union = union.unionByName(seed.densities(docs, terms, ranked))
    if forced:
        pinned = files.filter(F.col("path").rlike("|".join(f"^{_glob(p)}$" for p in forced)))
        union = union.unionByName(pinned.select(F.lit("task").alias("task_id"), "path", F.lit("S9").alias("signal"), F.lit(seed.WEIGHTS["S9"]).alias("score")))
    return union


def _forced(path: Column, forced: list[str]) -> Column:
    return path.rlike("|".join(f"^{_glob(p)}$" for p in forced)) if forced else F.lit(False)


def candidates(ranked: DataFrame, forced: list[str]) -> DataFrame:
    """The files that the fit decides on: all that earned a level, and all forced ones."""
    return ranked.filter((F.col("level") >= 1) | _forced(F.col("path"), forced))


def select(index: Index, text: str, budget: int = 16_000, forced: list[str] | None = None, source: Callable[[str], str] | None = None) -> Plan:
    """The plan of one task; with no seed over the floor, the map of what is imported most.

    source reads a file's text, for the cost of whole files; without it, size / 3 stands for it.
    """
    index.require_ready()
    parsed, forced = task.parse(text), forced or []
    signals = seeds_of(index, parsed, forced).persist()
    seeds = seed.totals(signals).persist()
    plan = Plan(text, budget, index.manifest["snapshot_id"], "slice")
    edges, files = index.read("edges"), index.read("files")
    if seed.in_map_mode(seeds):
        plan.mode = "map"
        degree = walk.import_degree(edges)
        ranked = files.join(degree, "path", "left").select(F.lit("task").alias("task_id"), "path", (F.coalesce("degree", F.lit(0)) / (F.coalesce("degree", F.lit(0)) + 2)).alias("total"), F.lit(3).alias("level"))
    else:
        pinned = seeds.withColumn("seed", F.when(F.col("path").rlike("|".join(f"^{_glob(p)}$" for p in forced)), 1.0).otherwise(F.col("seed"))) if forced else seeds
        walked = walk.walk(pinned.select("task_id", "path", "seed"), walk.traversal(edges, parsed["flags"]["test_bias"]))
        named = signals.filter("signal IN ('S1', 'S2')").select("task_id", "path")
        ranked = levels.assign(walked.select("task_id", "path", "total", role(F.col("path")).alias("role")), edges, named, parsed["flags"]["config_bias"])
    rows = [r.asDict() for r in candidates(ranked, forced).join(files.select("path", "lang", "size"), "path").collect()]
    plan.excluded = files.count() - len(rows)
    paths = index.spark.createDataFrame([(r["path"],) for r in rows] or [("",)], "path string")
    symbols: dict[str, list[dict]] = {}
    wanted = {t["lower"] for t in parsed["terms"]}
    for s in index.read("symbols").join(paths, "path", "left_semi").orderBy("path", "line", "name").collect():
        symbols.setdefault(s["path"], []).append(s.asDict() | {"selected": s["name"].lower() in wanted})
    signals.unpersist()
    seeds.unpersist()
    for r in rows:
        own = symbols.get(r["path"], [])
        names = "\n".join(f"{s['kind']} {s['name']}" for s in own)
        declared = names + "\n".join((s["signature"] or "") + (s["doc"] or "").split("\n")[0] for s in own)
        whole = levels.estimate(source(r["path"])) if source and r["level"] >= 4 else r["size"] // 3
        texts = {1: levels.estimate(f"{r['path']} {r['lang']} {r['size']}"), 2: levels.estimate(names), 3: levels.estimate(declared)}
        r["symbols"], r["cost"] = own, {0: 0} | {k: levels.slack(v) for k, v in texts.items()} | {4: levels.slack(max(texts[3], whole // 2)), 5: levels.slack(max(texts[3], whole))}
    fitted = levels.fit(rows, budget, frozenset(r["path"] for r in rows if any(re.fullmatch(_glob(p), r["path"]) for p in forced)))
    plan.rows = sorted(({**r, "level": fitted[r["path"]]} for r in rows), key=lambda r: (-r["level"], -r["total"], r["path"]))
    return plan


def render(plan: Plan, source: Callable[[str], str]) -> str:
    header = {"task": plan.task, "mode": plan.mode, "budget": str(plan.budget), "snapshot": plan.snapshot_id}
    return levels.render(header, plan.rows, source, plan.excluded)
