"""The index on any Hadoop file system: Parquet segments and a numbered manifests, of which the last counts.

A table is a list of segments. An update writes only its new rows, and the paths that older segments no longer
speak for; a reader leaves those out by an anti-join, and after some updates the segments are merged. The
manifest names all that counts, so what a crash leaves beside it is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import DERIVED, FACTS, SCHEMA_VERSION, TABLES, conform

MERGE_AFTER = 8
FINGERPRINT = "go:1"
_OWNER = {"edges": "src"}


class IndexProblem(RuntimeError):
    """The index is not in the state that the call needs."""


class Index:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        at, conf = self._fs_path(self.path), spark._jsc.hadoopConfiguration()
        self._fs = at.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        self.number, self.manifest = self._load()

    # the manifest
    def _numbers(self) -> list[int]:
        at = self._fs_path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("MANIFEST-") and n.endswith(".json") and n[9:-5].isdigit())

    def _at(self, number: int) -> object:
        return self._fs_path(f"{self.path}/MANIFEST-{number:012d}.json")

    def _load(self) -> tuple[int, dict]:
        """The manifest of the highest number; 0 and an empty one where there is none."""
        number = max(self._numbers(), default=0)
        if not number:
            return 0, {"schema_version": SCHEMA_VERSION, "state": "empty", "snapshot_id": "", "config_fingerprint": FINGERPRINT, "update_in_progress": False, "version": 0, "segments": {}, "gone": {}}
        stream = self._fs.open(self._at(number))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def save(self, **changes: object) -> None:
        """Moves on to the next manifest, of which readers see nothing or all; fails if another writer did so first.

        It is written aside and renamed to the next number, which must not exist. Former manifests stay until the sweep, so a crash
        at any point leaves the old one or the new one in force.
        """
        new = self.manifest | changes
        aside = self._fs_path(f"{self.path}/MANIFEST.{uuid.uuid4().hex}.new")
        self._fs.mkdirs(self._fs_path(self.path))
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            out.close()
        self._publish(aside, self._at(self.number + 1))
        self.number, self.manifest = self.number + 1, new

    def _publish(self, aside: object, at: object) -> None:
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            self._files.rename(aside, at, options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise IndexProblem(f"another writer was first, or the manifest could not be written: {str(e)[:200]}") from e

    def step(self, expected: str, state: str, **changes: object) -> None:
        """Moves the life cycle on; fails if another writer moved it first."""
        number, found = self._load()
        if found["state"] != expected or number != self.number:
            raise IndexProblem(f"state {found['state']} at {number}, {expected} at {self.number} expected")
        self.save(state=state, **changes)

    def check_open(self) -> None:
        m = self.manifest
        if m["schema_version"] != SCHEMA_VERSION:
            raise IndexProblem(f"schema version {m['schema_version']}, {SCHEMA_VERSION} expected: rebuild")
        if m["state"] not in ("empty", "building", "ready"):
            raise IndexProblem(f"unknown state {m['state']}")
        if m["state"] == "ready" and not m["snapshot_id"]:
            raise IndexProblem("ready without a snapshot")
        if m["config_fingerprint"] != FINGERPRINT:
            raise IndexProblem("built with another configuration: rebuild")
        if m["state"] == "ready" and (missing := [t for t in TABLES if t != "packages" and t not in m["segments"]]):
            raise IndexProblem(f"tables missing: {', '.join(missing)}")

    def require_ready(self) -> None:
        """For readers: an unfinished update first, then an empty id."""
        self.check_open()
        if self.manifest["update_in_progress"]:
            raise IndexProblem("an update did not finish")
        if self.manifest["state"] != "ready" or not self.manifest["snapshot_id"]:
            raise IndexProblem("no finished snapshot")

    # tables
    def _dir(self, table: str, version: int) -> str:
        return f"{self.path}/v{version}/{table}"

    def read(self, table: str) -> DataFrame:
        if table == "packages":
            files = self.read("files").filter("pkg_name IS NOT NULL")
            return conform(files.select(F.col("pkg_dir").alias("dir"), F.col("pkg_name").alias("name"), "lang").distinct(), table)
        versions = self.manifest["segments"].get(table, [])
        empty = self.spark.createDataFrame([], TABLES[table])
        group = "derived" if table in DERIVED else "facts"
        later: DataFrame | None = None
        out = empty
        for v in sorted(versions, reverse=True):
            rows = self.spark.read.schema(TABLES[table]).parquet(self._dir(table, v))
            owner = _OWNER.get(table, "path")
            if later is not None:
                rows = rows.join(later.withColumnRenamed("path", owner), owner, "left_anti").select(*TABLES[table].names)
            out = out.unionByName(rows)
            if v in self.manifest["gone"].get(group, []):
                gone = self.spark.read.schema("path string").parquet(self._dir(f"gone_{group}", v))
                later = gone if later is None else later.unionByName(gone)
        return out

    def tables(self, names: tuple[str, ...]) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in names}

    def append(self, group: str, frames: dict[str, DataFrame], gone: DataFrame | None, **changes: object) -> None:
        """Writes a segment of the group's tables and the paths that it replaces, then swaps the manifest. Without ``gone`` it replaces all."""
        version = self.manifest["version"] + 1
        segments, marks = dict(self.manifest["segments"]), dict(self.manifest["gone"])
        for table, df in frames.items():
            if table == "packages":
                continue
            conform(df, table).write.mode("overwrite").parquet(self._dir(table, version))
            segments[table] = [version] if gone is None else [*segments.get(table, []), version]
        if gone is None:
            marks[group] = []
        else:
            gone.select("path").distinct().write.mode("overwrite").parquet(self._dir(f"gone_{group}", version))
            marks[group] = [*marks.get(group, []), version]
        self.save(version=version, segments=segments, gone=marks, **changes)

    def merge(self) -> None:
        """One segment per table, when they have become many."""
        for group, names in (("facts", tuple(t for t in FACTS if t != "packages")), ("derived", DERIVED)):
            if len(self.manifest["segments"].get(names[0], [])) > MERGE_AFTER:
                self.append(group, self.tables(names), None)

    def sweep(self) -> None:
        """Deletes versions that the manifest does not name."""
        live = {v for x in self.manifest["segments"].values() for v in x} | {v for x in self.manifest["gone"].values() for v in x}
        for f in self._fs.listStatus(self._fs_path(self.path)):
            name = f.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in live:
                self._fs.delete(f.getPath(), True)
        for number in self._numbers():
            if number < self.number:
                self._fs.delete(self._at(number), False)

    def reset(self) -> None:
        """To an empty index."""
        self._fs.delete(self._fs_path(self.path), True)
        self.number, self.manifest = self._load()
        self.save()


def dump(index: Index) -> list[str]:
    """Every row of every table as text, in order: what two equal indexes share. For tests of small ones."""
    out = []
    for table in TABLES:
        rows = index.read(table).select(F.to_json(F.struct(F.lit(table).alias("table"), *TABLES[table].names)).alias("r"))
        out += sorted(r["r"] for r in rows.collect())
    return out
