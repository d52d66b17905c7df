"""Scan of a source tree: what is there, minus what ignore files leave out, with language, size band and hash."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import LARGEST, dir_of, language, size_band
from codeloom.schemas import SCAN

MAX_FILES, MAX_BYTES = 500_000, 2 << 30
IGNORE_FILES = (".gitignore", ".ignore", ".codeloomignore")
PRUNED = frozenset({".git", ".codeloom"})


class CapExceeded(ValueError):
    """More files or bytes than a scan may hold; nothing is cut off silently."""


@dataclass(frozen=True)
class Rule:
    base: str
    pattern: re.Pattern
    negated: bool
    only_dirs: bool


def _regex(glob: str, anchored: bool) -> re.Pattern:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.DOTALL)


def rules_of(text: str, base: str) -> list[Rule]:
    """Rules of one ignore file in directory ``base``."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        if line:
            out.append(Rule(base, _regex(line.lstrip("/"), anchored), negated, only_dirs))
    return out


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides."""
    for r in reversed(rules):
        if r.only_dirs and not is_dir:
            continue
        if r.base and not path.startswith(r.base + "/"):
            continue
        if r.pattern.match(path[len(r.base) + 1 :] if r.base else path):
            return not r.negated
    return False


def normalize(path: str) -> str | None:
    """Parts joined by slashes without dots; null for what climbs or is absolute."""
    parts = [p for p in path.replace(os.sep, "/").split("/") if p not in ("", ".")]
    return None if ".." in parts or path.startswith("/") else "/".join(parts)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def discover(root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> list[tuple[str, int, int]]:
    """(path, size, mtime) in order of the path strings. Links are not followed; hidden files count. Errors of entries skip them, one of the root raises."""
    os.listdir(root)
    found: list[tuple[str, int, int]] = []
    total = 0
    base = _read(os.path.join(root, ".git", "info", "exclude"))

    def walk(folder: str, rel: str, rules: list[Rule]) -> None:
        nonlocal total
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        names = {e.name for e in entries}
        for name in IGNORE_FILES:
            if name in names:
                rules = [*rules, *rules_of(_read(os.path.join(folder, name)), rel)]
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if e.name not in PRUNED and not ignored(path, True, rules):
                        walk(e.path, path, rules)
                    continue
                if not e.is_file() or ignored(path, False, rules):
                    continue
                stat = e.stat()
            except OSError:
                continue
            total += stat.st_size
            found.append((path, stat.st_size, int(stat.st_mtime)))
            if len(found) > max_files or total > max_bytes:
                raise CapExceeded(f"{len(found)} files, {total} bytes")

    above: list[Rule] = []
    parent, up = os.path.dirname(os.path.abspath(root)), []
    while parent != os.path.dirname(parent):  # rules of parent folders, seen from the root by name alone
        up.append(parent)
        parent = os.path.dirname(parent)
    for folder in reversed(up):
        for name in IGNORE_FILES:
            text = "\n".join(x for x in _read(os.path.join(folder, name)).splitlines() if "/" not in x.rstrip("/"))
            above += rules_of(text, "")
    walk(root, "", [*above, *rules_of(base, "")])
    return sorted(found)


def scan_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, with_content: bool = True) -> DataFrame:
    """The scan table of a local tree: listed on the driver (paths and sizes only), read and hashed in tasks."""
    listed = spark.createDataFrame(discover(root, max_files, max_bytes), "path string, size bigint, mtime bigint")
    rows = listed.select("path", language(F.col("path")).alias("lang"), "size", "mtime", size_band(F.col("size")).alias("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, skips, contents = [], [], []
            for path, skip in zip(b["path"].to_pylist(), b["skip"].to_pylist(), strict=True):
                data = None
                if skip != "too_large":
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            data = f.read()
                    except OSError:
                        skip = "unreadable"
                hashes.append(hashlib.sha256(data).hexdigest() if data is not None else None)
                skips.append(skip)
                contents.append(data if with_content and skip is None else None)
            yield pa.RecordBatch.from_arrays([b["path"], b["lang"], b["size"], b["mtime"], pa.array(hashes, pa.string()), pa.array(skips, pa.string()), pa.array(contents, pa.binary())], SCAN.names)

    return rows.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, SCAN)


def _stored(spark: SparkSession, path: str) -> str | None:
    """The text of a file of any store, null where it is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode(errors="replace")
    finally:
        stream.close()


def scan_store(spark: SparkSession, path: str, glob: str = "*", rules: list[Rule] | None = None, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The scan table of any store that Spark reads, by its binary source; paths are seen from ``path``.

    What is too large is listed without being read. That reader does not show files whose names begin with a dot or an underscore; ignore files
    are looked for in each folder that holds a file, and count after ``rules``, the deeper the later. Pruned folders are left out.
    Only folders, ignore files and counts come to the driver. More files or bytes than the caps are an error.
    """
    root = path.split("://")[-1].rstrip("/").removeprefix("file:") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    listed = reader.load(path).withColumn("path", F.substring_index("path", root, -1))
    over = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    folders = {r["d"] for r in listed.select(dir_of(F.col("path")).alias("d")).distinct().limit(max_files + 1).collect()}
    folders |= {"/".join(d.split("/")[:k]) for d in folders for k in range(len(d.split("/")))}
    found = list(rules or [])
    for folder in sorted(folders, key=lambda d: (d.count("/") + bool(d), d)):
        for name in IGNORE_FILES:
            text = _stored(spark, f"{path.rstrip('/')}/{folder + '/' if folder else ''}{name}")
            found += rules_of(text, folder) if text else []

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        def one(p: str) -> bool:
            parts = p.split("/")
            above = ("/".join(parts[:k]) for k in range(1, len(parts)))
            return not (PRUNED & set(parts[:-1]) or any(ignored(x, True, found) for x in above) or ignored(p, False, found))

        return paths.map(one)

    files = listed.filter(kept("path")) if found or folders & PRUNED else listed
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first() if over[0] > max_files or over[1] > max_bytes else over
    if n > max_files or total > max_bytes:
        raise CapExceeded(f"{n} files, {total} bytes")
    small = files.filter(F.col("length") <= LARGEST).withColumn("skip", size_band(F.col("length"))).withColumn("hash", F.sha2("content", 256))
    large = files.filter(F.col("length") > LARGEST).select("path", "modificationTime", "length").withColumns({"skip": F.lit("too_large"), "hash": F.lit(None).cast("string"), "content": F.lit(None).cast("binary")})
    both = small.unionByName(large, allowMissingColumns=True)
    content = F.when(F.col("skip").isNull(), F.col("content"))
    rows = both.select("path", language(F.col("path")).alias("lang"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp").cast("long").alias("mtime"), "hash", "skip", content.alias("content"))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in SCAN.fields))
