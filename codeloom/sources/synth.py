"""A synthetic Go repository as a scan table, made in tasks; its facts can be counted in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import SCAN

PER_PACKAGE, FUNCTIONS, PER_TASK = 10, 8, 10_000


def synthetic_scan(spark: SparkSession, files: int, parts: int | None = None) -> DataFrame:
    """``files`` files in packages of ten. Each file has a type with one method and eight functions; the n-th function calls the next one of the file, and every file but those of the first package calls into the package before."""
    n = F.col("id")
    pkg = (n / PER_PACKAGE).cast("long")
    name = F.concat(F.lit("p"), pkg.cast("string"))
    before = F.concat(F.lit("p"), (pkg - 1).cast("string"))
    k = F.concat(n.cast("string"), F.lit("_"))
    calls = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)), lambda i: F.concat(F.lit("func F"), k, i.cast("string"), F.lit("(a int) int { return F"), k, ((i + 1) % FUNCTIONS).cast("string"), F.lit("(a) }\n"))), "\n"
    )
    imports = F.when(pkg > 0, F.concat(F.lit('import "example.com/s/'), before, F.lit('"\n\nfunc Up'), n.cast("string"), F.lit("() int { return "), before, F.lit(".F"), (n - PER_PACKAGE).cast("string"), F.lit("_0(1) }\n\n"))).otherwise("")
    body = F.concat(F.lit("package "), name, F.lit("\n\n"), imports, F.lit("// T"), n.cast("string"), F.lit(" is a type.\ntype T"), n.cast("string"), F.lit(" struct{ n int }\n\nfunc (t T"), n.cast("string"), F.lit(") M"), n.cast("string"), F.lit("() int { return t.n }\n\n"), calls)
    rows = spark.range(0, files, 1, parts or max(spark.sparkContext.defaultParallelism, files // PER_TASK)).select(F.concat(name, F.lit("/f"), n.cast("string"), F.lit(".go")).alias("path"), body.cast("binary").alias("content"))
    mod = spark.createDataFrame([("go.mod", bytearray(b"module example.com/s\n"))], "path string, content binary")
    both = rows.unionByName(mod)
    return both.select("path", F.lit("go").alias("lang"), F.octet_length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.sha2("content", 256).alias("hash"), F.lit(None).cast("string").alias("skip"), "content").select(*SCAN.names)


def expected(files: int) -> dict[str, int]:
    """Counts by construction, for a multiple of ten files."""
    later = max(0, files - PER_PACKAGE)
    return {
        "symbols": files * (FUNCTIONS + 2) + later,
        "imports": later,
        "import_out": later * PER_PACKAGE,
        "ref_def": later,
    }
