"""Health checks of an index: one row (code, severity, n, message, details) per check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.store import Index
from codeloom.schemas import FACTS, KEYS, SCHEMA_VERSION, STATES, TABLES, broken_files

SCHEMA = "code string, severity string, n bigint, message string, details array<string>"
SAMPLE = 10


def _meta(index: Index) -> list[tuple]:
    """From the manifest alone."""
    m, out = index.manifest, []
    say = lambda code, severity, message: out.append((code, severity, 1, message, []))
    version = m.get("schema_version")
    if version is None:
        say("SCHEMA_VERSION_MISSING", "error", "no schema version")
    elif not isinstance(version, int):
        say("SCHEMA_VERSION_INVALID", "error", f"schema version {version!r}")
    elif version != SCHEMA_VERSION:
        say("SCHEMA_VERSION_MISMATCH", "error", f"schema version {version}, {SCHEMA_VERSION} expected: rebuild")
    else:
        say("SCHEMA_VERSION", "ok", str(version))
    state = m.get("state")
    code = {None: "INDEX_STATE_MISSING", "building": "INDEX_STATE_BUILDING", "empty": "INDEX_STATE_EMPTY", "ready": "INDEX_STATE"}.get(state, "INDEX_STATE_INVALID")
    say(code, {"ready": "ok", "building": "warning", "empty": "warning"}.get(state, "error"), str(state))
    if state == "ready" or m.get("snapshot_id"):
        snapshot = m.get("snapshot_id") or ""
        good = bool(re.fullmatch("[0-9a-f]{64}", snapshot))
        say("SNAPSHOT_ID" if good else "SNAPSHOT_ID_MALFORMED" if snapshot else "SNAPSHOT_ID_MISSING", "ok" if good else "error", snapshot)
    if m.get("update_in_progress"):
        say("UPDATE_INCOMPLETE", "error", "an update did not finish: run it again")
    missing = [t for t in TABLES if t != "packages" and t not in m.get("segments", {})]
    if state in STATES and state != "empty":
        out.append(("SCHEMA_TABLES_MISSING", "error", len(missing), "tables missing", missing) if missing else ("SCHEMA_TABLES", "ok", len(TABLES), "all tables are there", []))
    return out


def _finding(rows: DataFrame, show: str, code: str, clean: str, message: str, severity: str = "error") -> DataFrame:
    """One row: how many offend, and the first ten of them in order; the clean code if none does."""
    first = rows.select(F.expr(show).alias("x")).orderBy("x").limit(SAMPLE).agg(F.array_sort(F.collect_list("x")).alias("details"))
    both = rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first), F.lit(True))  # one row each
    return both.select(F.when(F.col("n") > 0, code).otherwise(clean).alias("code"), F.when(F.col("n") > 0, severity).otherwise("ok").alias("severity"), "n", F.lit(message).alias("message"), "details")


def _percent(part: object, whole: object) -> object:
    return F.format_string("%.1f%%", F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(100.0)))


def examine(index: Index) -> DataFrame:
    """All checks; those on rows only when there are tables."""
    spark = index.spark
    out = spark.createDataFrame(_meta(index), SCHEMA)
    if any(t not in index.manifest["segments"] for t in TABLES if t != "packages"):
        return out
    t = index.tables(tuple(TABLES))
    files, symbols, refs, imports = t["files"], t["symbols"], t["refs"], t["imports"]
    found: list[DataFrame] = [_finding(broken_files(files), "path", "FILES_CONSISTENCY_VIOLATIONS", "FILES_CONSISTENCY", "states of files that the schema forbids")]
    for name, keys in KEYS.items():
        twice = t[name].groupBy(*keys).count().filter("count > 1")
        found.append(_finding(twice, f"concat_ws(':', '{name}', {', '.join(keys)})", "KEYS_REPEATED", "KEYS", f"keys of {name} that occur twice"))
    alone = lambda df, c: df.join(files.select(F.col("path").alias(c)), c, "left_anti")
    for name in (*(x for x in FACTS if x not in ("packages", "files")), "import_resolution", "bindings"):
        found.append(_finding(alone(t[name], "path"), f"concat_ws(':', '{name}', path)", "FOREIGN_KEYS_VIOLATIONS", "FOREIGN_KEYS", f"rows of {name} without a file"))
    targets, edges = t["binding_targets"], t["edges"]
    dangling = alone(targets, "target_path").select(F.concat_ws(" -> ", "path", "target_path").alias("x"))
    for c in ("src", "dst"):
        dangling = dangling.union(alone(edges, c).select(F.concat_ws(" -> ", "src", "dst")))
    dangling = dangling.union(edges.filter("src = dst").select(F.concat_ws(" -> ", "src", "dst")))
    found.append(_finding(dangling, "x", "REFERENTIAL_INTEGRITY_VIOLATIONS", "REFERENTIAL_INTEGRITY", "targets or edges that lead nowhere, and edges to themselves"))
    packaged = files.filter("pkg_name IS NOT NULL AND path LIKE '%.go'").select("path")
    unbound = refs.join(packaged, "path", "left_semi").join(t["bindings"], ["path", "start_byte", "end_byte"], "left_anti")
    found.append(_finding(unbound, "concat_ws(':', path, start_byte)", "PROJECTION_INCOMPLETE", "DERIVED_PROJECTION", "references without a binding"))
    open_ = imports.join(packaged, "path", "left_semi").join(t["import_resolution"].filter("resolved_dir IS NOT NULL OR unresolved_reason IS NOT NULL"), ["path", "ordinal"], "left_anti")
    found.append(_finding(open_, "concat_ws(':', path, ordinal)", "IMPORTS_UNCLASSIFIED", "IMPORTS_CLASSIFIED", "imports without an outcome"))
    for df in found:
        out = out.unionByName(df)
    return out.unionByName(_metrics(files, symbols, refs, imports, t["import_resolution"], t["bindings"], edges))


def _metrics(files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame, resolution: DataFrame, bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers, none of them a fault but anomalies of parsing."""
    status = files.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("parse_status") == s).alias(s) for s in ("ok", "partial", "timeout", "skipped", "unsupported")))
    none = F.array().cast("array<string>")
    row = lambda df, code, severity, n, message: df.select(F.lit(code).alias("code"), severity.alias("severity"), n.cast("bigint").alias("n"), message.alias("message"), none.alias("details"))
    ok = F.lit("ok")
    bad = F.col("partial") + F.col("timeout")
    parts = [
        row(status, "FILE_METRICS", ok, F.col("n"), F.format_string("ok %d, partial %d, timeout %d, skipped %d, unsupported %d", "ok", "partial", "timeout", "skipped", "unsupported")),
        row(status, "PARSE_ANOMALIES", F.when(bad > 0, "warning").otherwise("ok"), bad, F.lit("files parsed in part or not in time")),
        row(edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("s")), "GRAPH_METRICS", ok, F.col("n"), F.format_string("edges from %d files", "s")),
    ]
    r = resolution.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved_dir").isNotNull()).alias("r"), F.count_if(F.col("unresolved_reason") == "external").alias("e"))
    parts.append(row(r, "IMPORT_RESOLUTION_RATE", ok, F.col("n"), F.concat(_percent(F.col("r"), F.col("n")), F.lit(" of all, "), _percent(F.col("r"), F.col("n") - F.col("e")), F.lit(" of those in the repository"))))
    b = bindings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unbound_reason").isNull()).alias("b"))
    parts.append(row(b, "REF_BINDING_RATE", ok, F.col("n"), _percent(F.col("b"), F.col("n"))))
    for name, df in (("symbols", symbols), ("refs", refs), ("imports", imports)):
        parts.append(row(df.agg(F.count(F.lit(1)).alias("n")), f"ROWS_{name.upper()}", ok, F.col("n"), F.lit(f"rows of {name}")))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out
