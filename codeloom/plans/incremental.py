"""Building and maintaining an index: cold, resumed and incremental, with one derivation for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.relational import classify, snapshot_id
from codeloom.plans.derive import derive, release
from codeloom.plans.stage import Stage
from codeloom.plans.store import Index, IndexProblem
from codeloom.schemas import DERIVED, FACTS
from codeloom.sources.facts import extract, fact_tables
from codeloom.sources.golang import BUDGET

_STORED = tuple(t for t in FACTS if t != "packages")


@dataclass
class Run:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    rebuilt_all: bool = False
    affected: int = 0

    @property
    def noop(self) -> bool:
        return not (self.added or self.modified or self.deleted or self.rebuilt_all)


def snapshot_of(files: DataFrame) -> str:
    """Hash of all paths and content hashes; a file without one has a mark instead."""
    return snapshot_id(files, F.col("path"), F.coalesce("hash", F.lit("<too_large>"))).first()[0] or ""


def _facts(scan: DataFrame, budget: int) -> dict[str, DataFrame]:
    """Parsed once: what is parsed is kept while the tables are written."""
    scan = scan.persist()
    parsed = extract(scan, budget).persist()
    return fact_tables(scan, parsed) | {"_scan": scan, "_parsed": parsed}


def _release(facts: dict[str, DataFrame]) -> None:
    facts["_parsed"].unpersist()
    facts["_scan"].unpersist()


def build(index: Index, scan: DataFrame, budget: int = BUDGET) -> None:
    """A cold build of an empty index."""
    index.check_open()
    index.step("empty", "building")
    facts = _facts(scan, budget)
    index.append("facts", {t: facts[t] for t in _STORED}, None)
    _release(facts)
    finish(index)


def _derive(index: Index, facts: dict[str, DataFrame], paths: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    derived = derive(facts, paths)
    index.append("derived", {t: derived[t] for t in DERIVED}, gone)
    release(derived)


def finish(index: Index) -> None:
    """Derives all from stored facts, and makes the index ready."""
    _derive(index, index.tables(FACTS))
    index.step("building", "ready", snapshot_id=snapshot_of(index.read("files")), update_in_progress=False)
    index.sweep()


def resume(index: Index, scan: DataFrame, budget: int = BUDGET) -> None:
    """Goes on with a build that was cut off: files whose stored hash is current are not parsed again."""
    index.check_open()
    if index.manifest["state"] != "building":
        raise IndexProblem("nothing to resume")
    if index.manifest["segments"].get("files"):
        stage = Stage(index.spark)
        change_facts(index, scan, diff(index, scan, stage), budget)
        stage.release()
    else:
        facts = _facts(scan, budget)
        index.append("facts", {t: facts[t] for t in _STORED}, None)
        _release(facts)
    finish(index)


def diff(index: Index, scan: DataFrame, stage: Stage) -> DataFrame:
    """(path, change) of scanned and stored files by hash; times are never trusted."""
    return stage.keep(classify(index.read("files"), scan, "path", "hash"), "changes")


def change_facts(index: Index, scan: DataFrame, changes: DataFrame, budget: int, **marks: object) -> None:
    """Facts of new and changed files replace the old; those of deleted ones go."""
    fresh = changes.filter("change IN ('added', 'modified')").select("path")
    facts = _facts(scan.join(fresh, "path", "left_semi"), budget)
    index.append("facts", {t: facts[t] for t in _STORED}, changes.filter("change <> 'unchanged'").select("path"), **marks)
    _release(facts)


def affected_files(before: DataFrame, files: DataFrame, targets: DataFrame, resolution: DataFrame, changes: DataFrame) -> DataFrame:
    """(path) of files to derive again: all packages in the directories of changed files, and those that bind into or import them."""
    touched = changes.filter("change <> 'unchanged'").select("path")
    both = before.select("path", "pkg_dir", "pkg_name").unionByName(files.select("path", "pkg_dir", "pkg_name")).filter("pkg_name IS NOT NULL")
    dirs = both.join(touched, "path", "left_semi").select("pkg_dir").distinct()
    inside = both.join(dirs, "pkg_dir", "left_semi").select("path")
    binders = targets.join(inside.withColumnRenamed("path", "target_path"), "target_path", "left_semi").select("path")
    importers = resolution.join(dirs.withColumnRenamed("pkg_dir", "resolved_dir"), "resolved_dir", "left_semi").select("path")
    packages = both.join(inside.union(binders).union(importers), "path", "left_semi").select("pkg_dir", "pkg_name").distinct()
    return files.join(packages, ["pkg_dir", "pkg_name"], "left_semi").select("path").distinct()


def update(index: Index, scan: DataFrame, budget: int = BUDGET) -> Run:
    """Brings a ready index up to a scan.

    Facts are written first, with a mark that the derived tables lag; then these. If the mark is found set, a
    former update was cut off there, and all is derived again, as it is when a package came or went or a manifest changed.
    """
    index.check_open()
    if index.manifest["state"] != "ready":
        raise IndexProblem("not ready")
    torn = index.manifest["update_in_progress"]
    scan, stage = scan.persist(), Stage(index.spark)
    changes = diff(index, scan, stage)
    n = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    run = Run(*(n.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")))
    if run.noop and not torn:
        stage.release()
        scan.unpersist()
        return run
    before_files = stage.keep(index.read("files").select("path", "pkg_dir", "pkg_name", "lang"), "before")
    old_targets, old_resolution = index.read("binding_targets"), index.read("import_resolution")
    if not run.noop:
        change_facts(index, scan, changes, budget, update_in_progress=True)
    facts = index.tables(FACTS)
    after_files = stage.keep(facts["files"].select("path", "pkg_dir", "pkg_name", "lang"), "after")
    sides = [df.filter("pkg_name IS NOT NULL").groupBy("pkg_dir", "pkg_name", "lang").agg(F.lit(k).alias("side")) for k, df in enumerate((before_files, after_files))]
    moved = not sides[0].unionByName(sides[1]).groupBy("pkg_dir", "pkg_name", "lang").count().filter("count = 1").isEmpty()
    manifests = not changes.filter("change <> 'unchanged' AND (path = 'go.mod' OR path LIKE '%/go.mod')").isEmpty()
    vendored = not changes.filter("change IN ('added', 'deleted') AND path LIKE 'vendor/%'").isEmpty()
    if torn or moved or manifests or vendored:
        run.rebuilt_all = True
        _derive(index, facts)
    else:
        paths = stage.keep(affected_files(before_files, after_files, old_targets, old_resolution, changes), "paths")
        run.affected = paths.count()
        gone = paths.unionByName(changes.filter("change = 'deleted'").select("path"))
        _derive(index, facts, paths, gone)
    index.save(update_in_progress=False, snapshot_id=snapshot_of(index.read("files")))
    index.merge()
    index.sweep()
    stage.release()
    scan.unpersist()
    return run


def rebuild(index: Index, scan: DataFrame, budget: int = BUDGET) -> None:
    """From nothing, whatever was there."""
    index.reset()
    build(index, scan, budget)


def bring_up(index: Index, scan: DataFrame, budget: int = BUDGET) -> Run | None:
    """What the index command does: builds, resumes or updates, by the state found."""
    state = index.manifest["state"]
    if state == "empty":
        return build(index, scan, budget)
    return resume(index, scan, budget) if state == "building" else update(index, scan, budget)


__all__ = ["DERIVED", "Run", "bring_up", "build", "diff", "rebuild", "resume", "update"]
