"""Path and import-path scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dir_of(path: Column) -> Column:
    """Text before the last slash, or empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def join_dir(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(last_segment(path), r"(.)\.[^.]*$", "$1")


def extension_of(path: Column) -> Column:
    """Lower-cased text after the name's last dot, or null."""
    ext = F.regexp_extract(F.lower(last_segment(path)), r"\.([^.]*)$", 1)
    return F.when(F.instr(last_segment(path), ".") > 0, ext)


def ancestors(path: Column) -> Column:
    """The directory itself and all its parents up to the root, which is empty; longest first."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve_relative(base: Column, raw: Column) -> Column:
    """``raw`` seen from directory ``base``; null when it climbs above the root."""
    stack = F.filter(F.split(base, "/"), lambda s: s != "")
    start = F.struct(stack.alias("at"), F.lit(False).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        at = F.when(up, F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).when((s == ".") | (s == ""), acc["at"]).otherwise(F.concat(acc["at"], F.array(s)))
        return F.struct(at.alias("at"), (acc["out"] | (up & (F.size(acc["at"]) == 0))).alias("out"))

    return F.aggregate(F.split(raw, "/"), start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["at"], "/")))


def is_relative(raw: Column) -> Column:
    return raw.isin(".", "..") | raw.startswith("./") | raw.startswith("../")


def looks_like_stdlib(raw: Column) -> Column:
    return ~F.contains(F.split_part(raw, F.lit("/"), F.lit(1)), F.lit("."))


def default_qualifier(raw: Column) -> Column:
    """Last segment, stepping over a version segment v<digits> that has something before it."""
    parts = F.split(raw, "/")
    last = F.element_at(parts, -1)
    return F.when(last.rlike("^v[0-9]+$") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def module_relative(module_dir: Column, path: Column) -> Column:
    """``path`` below ``module_dir``."""
    return F.when(module_dir == "", path).when(path == module_dir, F.lit("")).when(path.startswith(F.concat(module_dir, F.lit("/"))), F.substring(path, F.length(module_dir) + 2, F.length(path))).otherwise(path)


def internal_violation(importer: Column, target: Column) -> Column:
    """Whether the target lies under a directory named internal whose parent does not hold the importer.

    An ``internal`` at the very beginning has no parent to be outside of.
    """
    parts = F.split(target, "/")
    at = F.array_position(F.slice(parts, F.lit(2), F.size(parts)), "internal")  # 1 for the second segment
    parent = F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/")
    inside = (importer == parent) | importer.startswith(F.concat(parent, F.lit("/")))
    return (at > 0) & ~inside


def module_path(manifest: Column) -> Column:
    """The module line's path: comments cut, quotes trimmed; null where there is none."""
    lines = F.transform(F.split(manifest, "\n"), lambda s: F.trim(F.regexp_replace(s, "//.*$", "")))
    found = F.filter(lines, lambda s: s.rlike(r"^module\s+\S"))
    return F.regexp_replace(F.regexp_extract(F.get(found, F.lit(0)), r"^module\s+(\S+)", 1), "^[\"'`]+|[\"'`]+$", "")


#: Names that say a language by themselves, then extensions.
NAMES = {"go.mod": "go", "go.sum": "go", "setup.py": "python", "setup.cfg": "python", "pyproject.toml": "python", "pyrightconfig.json": "python", "jsconfig.json": "typescript", "tsconfig.json": "typescript"}
EXTENSIONS = {"go": "go", "tsx": "tsx"} | dict.fromkeys(("cts", "mts", "ts"), "typescript") | dict.fromkeys(("jsx", "cjs", "mjs", "js"), "javascript") | dict.fromkeys(("pyi", "py"), "python") | dict.fromkeys("bash c cc cpp cs h hpp java kt lua php rb rs scala sh swift zsh".split(), "unsupported")


def language(path: Column) -> Column:
    """Language by name, then by last extension, without regard to case; else unknown."""
    name = F.lower(last_segment(path))
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    exts = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(exts, extension_of(path)), F.lit("unknown"))


#: Bytes above which files are not read, and not parsed.
LARGEST, PARSED = 50 * 1024 * 1024, 1024 * 1024


def size_band(size: Column) -> Column:
    """too_large above 50 MiB (not read), parse_skipped above 1 MiB (hashed), else null."""
    return F.when(size > LARGEST, "too_large").when(size > PARSED, "parse_skipped")
