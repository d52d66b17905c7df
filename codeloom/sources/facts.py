"""Facts of scanned files: parsed in Arrow batches, then spread over the fact tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.paths import dir_of
from codeloom.schemas import EXTRACTED, conform
from codeloom.sources import golang

#: Language kernels, bytes and a budget of steps to facts; languages without one are unsupported.
KERNELS: dict[str, Callable[[bytes, int], golang.File]] = {"go": golang.parse}
_PARSED = f"path:string,{EXTRACTED}"


def _column(kind: pa.ListType, lists: list[list[dict]]) -> pa.Array:
    """Lists of rows as one array, built by columns."""
    ends, rows = np.cumsum([0, *map(len, lists)]), [x for own in lists for x in own]
    fields = list(kind.value_type)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([x[f.name] for x in rows], f.type) for f in fields], fields=fields), type=kind)


def extract(scan: DataFrame, budget: int = golang.BUDGET) -> DataFrame:
    """(path, package_name, status, defs, refs, imports) of every file.

    Skipped files and manifests have status skipped, languages without a kernel unsupported, both without facts.
    """
    schema = T.StructType.fromDDL(_PARSED)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for path, lang, content in zip(*(b[c].to_pylist() for c in ("path", "lang", "content")), strict=True):
                if content is None or path.rpartition("/")[2] in ("go.mod", "go.sum"):
                    got = golang.File(status="skipped")
                elif lang not in KERNELS:
                    got = golang.File(status="unsupported")
                else:
                    got = KERNELS[lang](content, budget)
                files.append(got)
            head = [b["path"], pa.array([f.package_name for f in files], pa.string()), pa.array([f.status for f in files], pa.string())]
            yield pa.RecordBatch.from_arrays([*head, *(_column(arrow.field(c).type, [getattr(f, c) for f in files]) for c in ("defs", "refs", "imports"))], schema=arrow)

    return scan.select("path", "lang", "content").mapInArrow(run, schema)


def fact_tables(scan: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """The fact tables; ``parsed`` is read once per table, so it should be stored."""
    meta = scan.select("path", "lang", "hash", "skip", "size", "mtime", "content")
    files = meta.drop("content").join(parsed.select("path", "package_name", "status"), "path")
    named = F.col("package_name").isNotNull()
    files = files.select("path", "lang", F.when(named, dir_of(F.col("path"))).alias("pkg_dir"), F.col("package_name").alias("pkg_name"), "hash", "skip", "size", "mtime", F.col("status").alias("parse_status"), F.lit(None).cast("bigint").alias("tokens_est"))
    some = parsed.filter(F.col("status").isin("ok", "partial"))
    each = lambda c: some.select("path", F.posexplode(c).alias("ordinal", "x")).select("path", "ordinal", "x.*")
    defs = each("defs").withColumn("line", F.col("start_line"))
    refs = each("refs").withColumn("line", F.col("start_line"))
    manifests = meta.filter(F.element_at(F.split("path", "/"), -1) == "go.mod").filter("content IS NOT NULL")
    out = {
        "packages": files.filter("pkg_name IS NOT NULL").select(F.col("pkg_dir").alias("dir"), F.col("pkg_name").alias("name"), "lang").distinct(),
        "files": files, "symbols": defs, "refs": refs, "imports": each("imports"),
        "manifests": manifests.select("path", F.decode("content", "UTF-8").alias("content")),
    }
    return {k: conform(v, k) for k, v in out.items()}
