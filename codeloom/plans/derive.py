"""The derived tables as one function of the facts: imports resolved, references bound, files linked.

Cold builds, updates and repairs all call :func:`derive`; an update only narrows the files for which rows
are wanted, never what they may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import ancestors, default_qualifier, dir_of, internal_violation, is_relative, last_segment, module_path, module_relative, resolve_relative
from codeloom.functions.text import ref_weight
from codeloom.operators.relational import CANDIDATE_CAP, first_wins, importable
from codeloom.plans.stage import Stage
from codeloom.schemas import conform

#: Methods of everyday interfaces, whose names say nothing about the receiver.
UNIVERSE_METHODS = ("String", "Error", "Close", "Read", "Write", "Len", "Less", "Swap", "Run", "Scan", "Value", "Seek", "Flush", "Format", "Header", "Partial", "ReadFrom", "RoundTrip", "ServeHTTP", "WriteString")
TYPE_KINDS = ("struct", "interface", "type")
KINDS = {"type_ref": TYPE_KINDS, "call_ref": ("func", "var"), "field_ref": ("var", "const", "type", "struct", "interface")}
IMPORT_OUT, TEST_AFFINITY = 0.6, 0.7


def rate(part: Column, whole: Column) -> Column:
    """part / whole, and 1 of nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(1.0))


def modules(manifests: DataFrame) -> DataFrame:
    """(mod_dir, mod_path); the root is a module in any case."""
    found = manifests.select(dir_of(F.col("path")).alias("mod_dir"), F.coalesce(module_path(F.col("content")), F.lit("")).alias("mod_path"))
    root = manifests.sparkSession.createDataFrame([("", "")], "mod_dir string, mod_path string")
    return found.unionByName(root.join(found.filter("mod_dir = ''"), "mod_dir", "left_anti"))


def owners(dirs: DataFrame, mods: DataFrame) -> DataFrame:
    """(dir, mod_dir, mod_path): the nearest module of each directory."""
    up = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("mod_dir"))
    hit = up.join(mods, "mod_dir")
    best = hit.groupBy("dir").agg(F.max_by(F.struct("mod_dir", "mod_path"), F.length("mod_dir")).alias("m"))
    return best.select("dir", "m.mod_dir", "m.mod_path")


def resolve_imports(files: DataFrame, imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, ordinal, raw, alias, resolved_dir, unresolved_reason).

    Relative, then the importer's own module, then a vendored directory, else external. What falls into another module
    is external, what breaks the rule on internal is so marked, an unknown directory is not found.
    """
    mods = modules(manifests)
    known = files.filter("pkg_name IS NOT NULL").select(F.col("pkg_dir").alias("target")).distinct().withColumn("known", F.lit(True))
    vendored = not files.filter(F.col("path").startswith("vendor/")).isEmpty()
    rows = imports.withColumn("dir", dir_of(F.col("path")))
    own = owners(rows.select("dir").distinct(), mods)
    rows = rows.join(own, "dir")
    raw, mod = F.col("raw"), F.col("mod_path")
    inside = (mod != "") & raw.startswith(F.concat(mod, F.lit("/")))
    below = F.substring(raw, F.length(mod) + 2, F.length(raw))
    target = (
        F.when(is_relative(raw), resolve_relative(F.col("dir"), raw))
        .when((mod != "") & (raw == mod), F.col("mod_dir"))
        .when(inside, F.when(F.col("mod_dir") == "", below).otherwise(F.concat_ws("/", "mod_dir", below)))
    )
    kind = F.when(is_relative(raw), "relative").when(((mod != "") & (raw == mod)) | inside, "module").when(F.lit(vendored), "vendor").otherwise("external")
    rows = rows.withColumn("class", kind).withColumn("target", F.when(F.col("class") == "vendor", F.concat(F.lit("vendor/"), raw)).otherwise(target))
    rows = rows.join(known, "target", "left")
    theirs = owners(rows.filter("target IS NOT NULL").select(F.col("target").alias("dir")).distinct(), mods).select(F.col("dir").alias("target"), F.col("mod_dir").alias("their_dir"))
    rows = rows.join(theirs, "target", "left")
    seen = internal_violation(module_relative(F.col("mod_dir"), F.col("dir")), module_relative(F.col("mod_dir"), F.col("target")))
    reason = (
        F.when((F.col("class") == "external") | ((F.col("class") == "vendor") & F.col("known").isNull()), "external")
        .when(F.col("class") == "vendor", None)
        .when(F.col("target").isNull(), "escapes_root")
        .when(F.col("their_dir") != F.col("mod_dir"), "external")
        .when(seen, "internal")
        .when(F.col("known").isNull(), "not_found")
    )
    rows = rows.withColumn("unresolved_reason", reason)
    return rows.select("path", "ordinal", "raw", "alias", F.when(F.col("unresolved_reason").isNull(), F.col("target")).alias("resolved_dir"), "unresolved_reason")


def scopes(resolved: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Qualifiers (path, qualifier, in_repo, target_dir, target_name), the first import of a name winning, and dot imports (path, target_dir, target_name)."""
    packages = files.filter("pkg_name IS NOT NULL").select(F.col("pkg_dir").alias("dir"), F.col("pkg_name").alias("name")).distinct()
    best = importable(packages).select(F.col("dir").alias("resolved_dir"), F.col("name").alias("target_name"))
    rows = resolved.join(best, "resolved_dir", "left")
    inner = F.col("resolved_dir").isNotNull()
    # A directory without an importable package is named by its last part, and nothing binds into it.
    name = F.coalesce("alias", F.when(inner, F.coalesce("target_name", last_segment(F.col("raw")))).otherwise(default_qualifier(F.col("raw"))))
    named = rows.filter("alias IS NULL OR alias NOT IN ('.', '_')").withColumn("qualifier", name)
    first = first_wins(named, ["path", "qualifier"], ["ordinal"])
    in_repo = first.select("path", "qualifier", (F.col("resolved_dir").isNotNull() & F.col("target_name").isNotNull()).alias("in_repo"), F.col("resolved_dir").alias("target_dir"), "target_name")
    dots = rows.filter("alias = '.' AND resolved_dir IS NOT NULL AND target_name IS NOT NULL").select("path", F.col("resolved_dir").alias("target_dir"), "target_name").distinct()
    return in_repo, dots


_REF = ["path", "start_byte", "end_byte"]


def bind(files: DataFrame, symbols: DataFrame, refs: DataFrame, resolved: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Bindings (ref, unbound_reason, whether its qualifier is in scope) and targets (ref, target_path, qual_name, kind).

    Each class of references takes one branch of the rules; every reference gets exactly one row.
    """
    own_files = files.filter("pkg_name IS NOT NULL").select("path", F.col("pkg_dir").alias("dir"), F.col("pkg_name").alias("pkg"), F.col("path").endswith("_test.go").alias("is_test"))
    defs = symbols.join(own_files, "path").select("dir", "pkg", "name", F.col("path").alias("target_path"), "qual_name", "kind", "exported", F.col("is_test").alias("in_test"))
    # Definitions of a name in a file under several spans are one target.
    defs = stage.keep(defs.distinct(), "defs")
    exported = defs.filter("exported AND NOT in_test")
    qualifiers, dots = scopes(resolved, files)
    rows = refs.select(*_REF, "name", "kind", "qualifier").join(own_files, "path").join(qualifiers, ["path", "qualifier"], "left")
    rows = rows.withColumn("scope", F.when(F.col("qualifier").isNull(), "bare").when(F.col("in_repo").isNull(), "operand").when(F.col("in_repo"), "repo").otherwise("external"))
    rows = stage.keep(rows, "rows")
    kind, scope = F.col("kind"), F.col("scope")
    lexical = (kind == "name_ref") | ((kind == "type_ref") & (scope == "bare"))
    scoped = (kind != "name_ref") & (scope == "repo")
    method = (kind == "call_ref") & (scope == "operand") & ~F.col("name").isin(*UNIVERSE_METHODS)

    def kinds(of: Column) -> Column:
        ok = F.lit(False)
        for k, allowed in KINDS.items():
            ok |= (kind == k) & of.isin(*allowed)
        return ok

    visible = ~F.col("in_test") | F.col("is_test")
    # references through a qualifier
    theirs = exported.select(F.col("dir").alias("target_dir"), F.col("pkg").alias("target_name"), "name", "target_path", "qual_name", F.col("kind").alias("target_kind"))
    a = rows.filter(scoped).join(theirs, ["target_dir", "target_name", "name"]).filter(kinds(F.col("target_kind")) & ~F.col("qual_name").contains("."))
    a = a.select(*_REF, "target_path", "qual_name", F.col("target_kind"), F.lit("scoped").alias("via"))
    # lexical references: the package's own definitions, and those of dot imports
    plain = rows.filter(lexical)
    fits = (kind == "name_ref") | F.col("target_kind").isin(*TYPE_KINDS)
    mine = defs.filter(~F.col("qual_name").contains(".")).select("dir", "pkg", "name", "target_path", "qual_name", F.col("kind").alias("target_kind"), "in_test")
    b = plain.join(mine, ["dir", "pkg", "name"]).filter(visible & fits).select(*_REF, "target_path", "qual_name", "target_kind", F.lit("own").alias("via"))
    dotted = dots.join(theirs, ["target_dir", "target_name"]).filter(~F.col("qual_name").contains(".")).select("path", "name", "target_path", "qual_name", "target_kind")
    c = plain.join(dotted, ["path", "name"]).filter(fits).select(*_REF, "target_path", "qual_name", "target_kind", F.lit("dot").alias("via"))
    # calls on a plain operand: the package's only visible method of that name
    methods = defs.filter("kind = 'method'").select("dir", "pkg", "name", "target_path", "qual_name", F.col("kind").alias("target_kind"), "in_test")
    d = rows.filter(method).join(methods, ["dir", "pkg", "name"]).filter(visible).select(*_REF, "target_path", "qual_name", "target_kind", F.lit("method").alias("via"))
    # References and what they may mean lie together by file: after this one exchange, candidates are made distinct, counted and judged in place.
    found = a.unionByName(b).unionByName(c).unionByName(d)
    mark = F.col("via").isNull()
    both = rows.select(*_REF, "name", "kind", "scope").unionByName(found, allowMissingColumns=True).repartition("path")
    both = both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("times"))
    ref = Window.partitionBy(*_REF)
    said = both.select("*", F.count_if(~mark).over(ref).alias("n"), F.count_if(F.col("via") == "own").over(ref).alias("n_own"), F.count_if(F.col("via") == "dot").over(ref).alias("n_dot"))
    n = F.col("n")
    reason = (
        F.when(lexical, F.when((F.col("n_own") > 0) & (F.col("n_dot") > 0), "ambiguous_dot_import").when((n == 0) | (n > CANDIDATE_CAP), "no_candidate"))
        .when(scoped, F.when((n == 0) | (n > CANDIDATE_CAP), "no_candidate"))
        .when(scope == "external", "external_scope")
        .when(kind == "type_ref", "no_scope")
        .when((kind == "call_ref") & (scope == "bare"), "no_scope")
        .when(kind == "field_ref", "needs_type_info")
        .when(F.col("name").isin(*UNIVERSE_METHODS), "universe_method")
        .when(n == 0, "no_candidate")
        .when(n > 1, "method_ambiguous")
    )
    said = said.withColumn("unbound_reason", reason).withColumn("bound", F.max(mark & F.col("unbound_reason").isNull()).over(ref)).filter(mark | F.col("bound"))
    said = stage.keep(said.select(*_REF, "scope", "unbound_reason", "times", "via", "target_path", "qual_name", "target_kind"), "bindings")
    # A reference that stands in the facts more than once has as many rows.
    bindings = said.filter(mark).select(*_REF, "unbound_reason", F.col("scope").isin("repo", "external").alias("qualified"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).drop("nth")
    targets = said.filter(~mark).select(*_REF, "target_path", "qual_name", F.col("target_kind").alias("kind"))
    return bindings, targets


def link(files: DataFrame, resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight), one row per pair and kind."""
    own = files.filter("pkg_name IS NOT NULL").select("path", "pkg_dir", "pkg_name", F.col("path").endswith("_test.go").alias("is_test"))
    best = importable(own.select(F.col("pkg_dir").alias("dir"), F.col("pkg_name").alias("name")).distinct()).select(F.col("dir").alias("resolved_dir"), F.col("name").alias("pkg_name"))
    code = own.filter("NOT is_test").select(F.col("pkg_dir").alias("resolved_dir"), "pkg_name", F.col("path").alias("dst"))
    imports = resolved.filter("resolved_dir IS NOT NULL").select(F.col("path").alias("src"), "resolved_dir").join(best, "resolved_dir").join(code, ["resolved_dir", "pkg_name"])
    imports = imports.filter("src <> dst").select("src", "dst").distinct().select("src", "dst", F.lit("import_out").alias("kind"), F.lit(IMPORT_OUT).alias("weight"))
    used = targets.filter("path <> target_path").groupBy(F.col("path").alias("src"), F.col("target_path").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    used = used.select("src", "dst", F.lit("ref_def").alias("kind"), ref_weight(F.col("n")).alias("weight"))
    tests, others = own.filter("is_test").select(F.col("path").alias("src"), "pkg_dir"), own.filter("NOT is_test").select(F.col("path").alias("dst"), "pkg_dir")
    one = tests.join(others, "pkg_dir").select("src", "dst")
    near = one.union(one.select("dst", "src")).select("src", "dst", F.lit("test_affinity").alias("kind"), F.lit(TEST_AFFINITY).alias("weight"))
    return imports.unionByName(used).unionByName(near)


def derive(facts: dict[str, DataFrame], paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The derived tables; with ``paths`` (path), only rows that start in those files.

    What several of them need is computed once and kept until :func:`release`, which also keeps plans small.
    """
    stage = Stage(facts["files"].sparkSession)
    files = stage.keep(facts["files"].select("path", "pkg_dir", "pkg_name"), "files")
    narrow = lambda df, c="path": df.join(paths.select(F.col("path").alias(c)), c, "left_semi") if paths is not None else df
    resolved = stage.keep(resolve_imports(files, narrow(facts["imports"]), stage.keep(facts["manifests"], "manifests")), "resolved")
    bindings, targets = bind(files, facts["symbols"], narrow(facts["refs"]), resolved, stage)
    edges = link(files, resolved, targets)
    # A file that has no package clause takes no part.
    packaged = files.filter("pkg_name IS NOT NULL").select("path")
    resolution = resolved.join(packaged, "path", "left_semi").withColumn("resolved_file", F.lit(None).cast("string"))
    edges = edges.join(packaged.withColumnRenamed("path", "src"), "src", "left_semi")
    out = {"import_resolution": resolution, "bindings": bindings, "binding_targets": targets, "edges": narrow(edges, "src")}
    return {k: conform(v, k) for k, v in out.items()} | {"_stage": stage}


def release(derived: dict) -> dict[str, DataFrame]:
    """Lets go of what was kept; returns the tables alone."""
    if stage := derived.pop("_stage", None):
        stage.release()
    return derived


def statistics(derived: dict[str, DataFrame]) -> dict:
    """Counts of outcomes and rates, few rows each."""
    imports = {r["k"]: r["n"] for r in derived["import_resolution"].groupBy(F.when(F.col("unresolved_reason").isNull(), "resolved").when(F.col("unresolved_reason") == "external", "external").otherwise("unresolved").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    reasons = {r["unbound_reason"]: r["n"] for r in derived["bindings"].groupBy("unbound_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = reasons.pop(None, 0)
    edges = {r["kind"]: r["n"] for r in derived["edges"].groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    r, e, u = (imports.get(k, 0) for k in ("resolved", "external", "unresolved"))
    share = lambda a, b: a / b if b else 1.0
    unbound = sum(reasons.values())
    return {"imports": {"resolved": r, "external": e, "unresolved": u}, "refs": {"bound": bound, "unbound": unbound}, "reasons": reasons, "edges": edges, "import_rate": share(r, r + e + u), "in_repo_rate": share(r, r + u), "ref_rate": share(bound, bound + unbound)}
