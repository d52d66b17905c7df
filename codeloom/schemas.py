"""Tables of the index: explicit schemas with natural keys, closed vocabularies and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2

LANGUAGES = ("go", "typescript", "tsx", "javascript", "python", "unsupported", "unknown")
DEF_KINDS = ("func", "method", "const", "var", "type", "struct", "interface")
REF_KINDS = ("name_ref", "field_ref", "call_ref", "type_ref")
IMPORT_KINDS = ("import", "export-from", "require", "from-import")
PARSE_STATUSES = ("ok", "partial", "timeout", "skipped", "unsupported")
UNRESOLVED = ("external", "not_found", "escapes_root", "internal")
UNBOUND = ("no_candidate", "external_scope", "no_scope", "method_ambiguous", "ambiguous_dot_import", "needs_type_info", "universe_method")
EDGE_KINDS = ("import_out", "ref_def", "test_affinity")
STATES = ("empty", "building", "ready")

#: What a file's hash, skip and status may be together; null must count as a failure.
FILE_CHECK = (
    "((hash IS NULL AND coalesce(skip, '') IN ('too_large', 'unreadable') AND parse_status = 'skipped')"
    " OR (hash IS NOT NULL AND (skip IS NULL OR skip = 'parse_skipped')))"
)


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def _of(ddl: str) -> T.StructType:
    """A schema of plain columns; needs no session, so that modules can be imported without one."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))])


SPAN = "start_line:int,end_line:int,start_byte:int,end_byte:int"
EXTRACTED = (
    "package_name:string,status:string,"
    f"defs:array<struct<name:string,qual_name:string,kind:string,{SPAN},container:string,exported:boolean,signature:string,doc:string>>,"
    f"refs:array<struct<name:string,kind:string,qualifier:string,{SPAN},container:string>>,"
    f"imports:array<struct<raw:string,alias:string,kind:string,{SPAN}>>"
)
SCAN = _of("path string, lang string, size bigint, mtime bigint, hash string, skip string, content binary")
TABLES: dict[str, T.StructType] = {
    "packages": _of("dir string, name string, lang string"),
    "files": _of("path string, lang string, pkg_dir string, pkg_name string, hash string, skip string, size bigint, mtime bigint, parse_status string, tokens_est bigint"),
    "symbols": _of("path string, name string, qual_name string, kind string, exported boolean, line int, end_line int, start_byte int, end_byte int, signature string, container string, doc string"),
    "refs": _of("path string, name string, kind string, qualifier string, line int, start_byte int, end_byte int, container string"),
    "imports": _of("path string, ordinal int, raw string, alias string, kind string"),
    "manifests": _of("path string, content string"),
    "import_resolution": _of("path string, ordinal int, resolved_dir string, resolved_file string, unresolved_reason string"),
    "bindings": _of("path string, start_byte int, end_byte int, unbound_reason string"),
    "binding_targets": _of("path string, start_byte int, end_byte int, target_path string, qual_name string, kind string"),
    "edges": _of("src string, dst string, kind string, weight double"),
}
FACTS = ("packages", "files", "symbols", "refs", "imports", "manifests")
DERIVED = ("import_resolution", "bindings", "binding_targets", "edges")
KEYS: dict[str, list[str]] = {
    "packages": ["dir", "name", "lang"], "files": ["path"], "symbols": ["path", "start_byte", "name"], "refs": ["path", "start_byte", "end_byte"], "imports": ["path", "ordinal"],
    "manifests": ["path"], "import_resolution": ["path", "ordinal"], "bindings": ["path", "start_byte", "end_byte"], "binding_targets": ["path", "start_byte", "end_byte", "target_path", "qual_name"], "edges": ["src", "dst", "kind"],
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; a missing column is an error."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))


def broken_files(files: DataFrame) -> DataFrame:
    """Files that the checks forbid."""
    ok = F.expr(FILE_CHECK) & F.col("parse_status").isin(*PARSE_STATUSES)
    return files.filter(~F.coalesce(ok, F.lit(False)))
