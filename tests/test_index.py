"""Resolution, binding, edges; the index cold and incremental; the doctor."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators.doctor import examine
from codeloom.plans import incremental
from codeloom.plans.derive import derive, release, statistics
from codeloom.plans.store import Index, IndexProblem, dump
from codeloom.schemas import DERIVED, FACTS, TABLES, broken_files
from codeloom.sources.facts import extract, fact_tables
from codeloom.sources.scan import CapExceeded, scan_store, scan_tree
from codeloom.streaming.updates import apply_changes
from tests.repo import FILES, write


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("repo"))
    index = Index(spark, str(tmp_path_factory.mktemp("index") / "i"))
    incremental.build(index, scan_tree(spark, str(root)))
    return index


@pytest.fixture(scope="module")
def tables(built):
    return {t: [r.asDict() for r in built.read(t).collect()] for t in TABLES}


def outcome(tables, path):
    raws = {(i["path"], i["ordinal"]): i["raw"] for i in tables["imports"]}
    return {raws[i["path"], i["ordinal"]]: i["resolved_dir"] if i["resolved_dir"] is not None else i["unresolved_reason"] for i in tables["import_resolution"] if i["path"] == path}


def test_imports_resolve(tables):
    assert outcome(tables, "main.go") == {
        "fmt": "external", "example.com/m/v2/auth": "auth", "example.com/m/v2/dirhelper": "dirhelper", "example.org/dep": "vendor/example.org/dep",
        "example.com/m/v2/missing": "not_found", "example.com/m/v2/nested/inner": "external",
    }
    assert outcome(tables, "rel/r.go") == {"./sub": "rel/sub", "../../../up": "escapes_root"}
    assert outcome(tables, "deep/user/u.go") == {"example.com/m/v2/deep/internal/fs": "deep/internal/fs"}
    assert outcome(tables, "outside/o.go") == {"example.com/m/v2/deep/internal/fs": "internal"}


def bound(tables, path):
    names = {(r["path"], r["start_byte"]): r["name"] for r in tables["refs"]}
    out = {}
    for b in tables["bindings"]:
        if b["path"] == path:
            hits = sorted((t["target_path"], t["qual_name"]) for t in tables["binding_targets"] if (t["path"], t["start_byte"]) == (path, b["start_byte"]))
            out.setdefault(names[path, b["start_byte"]], set()).add(b["unbound_reason"] or tuple(hits))
    return out


def test_references_bind(tables):
    main = bound(tables, "main.go")
    assert main["Login"] == {(("auth/auth.go", "Login"),)}
    assert main["Help"] == {(("dirhelper/h.go", "Help"),)}
    assert main["Do"] == {(("vendor/example.org/dep/dep.go", "Do"),)}
    assert main["helper"] == {(("util.go", "helper"),)}
    assert main["Println"] == {"external_scope"} and main["Gone"] == {"external_scope"}
    assert main["unknown"] == {"no_candidate"}
    assert main["Session"] == {(("auth/auth.go", "Session"),)}
    assert main["Open"] == {"no_candidate"} and main["Close"] == {"universe_method"} and main["Name"] == {"needs_type_info"}
    meth = bound(tables, "meth/m.go")
    assert meth["One"] == {(("meth/m.go", "A.One"),)} and meth["Two"] == {"method_ambiguous"} and meth["String"] == {"universe_method"}
    dotted = bound(tables, "dotted/d.go")
    assert dotted["Value"] == {(("vals/v.go", "Value"),)} and dotted["Both"] == {"ambiguous_dot_import"}
    assert bound(tables, "tags/windows.go")["Sys"] == {(("tags/linux.go", "Sys"), ("tags/windows.go", "Sys"))}
    assert bound(tables, "auth/auth_test.go")["fixture"] == {(("auth/auth_test.go", "fixture"),)}


def test_edges(tables):
    edges = {(e["src"], e["dst"], e["kind"]): e["weight"] for e in tables["edges"]}
    assert edges["main.go", "auth/auth.go", "import_out"] == 0.6
    assert edges["main.go", "auth/auth.go", "ref_def"] == 0.5 * 2**0.5 / 10**0.5
    assert edges["auth/auth_test.go", "auth/auth.go", "test_affinity"] == edges["auth/auth.go", "auth/auth_test.go", "test_affinity"] == 0.7
    assert edges["auth/extern_test.go", "auth/auth.go", "test_affinity"] == 0.7
    assert not any(a == b for a, b, _ in edges)
    assert ("auth/extern_test.go", "auth/auth_test.go", "import_out") not in edges


def test_every_reference_has_one_binding(tables):
    keys = [(b["path"], b["start_byte"], b["end_byte"]) for b in tables["bindings"]]
    assert len(keys) == len(set(keys)) == len(tables["refs"])


def test_statistics(built):
    s = statistics(built.tables(tuple(TABLES)))
    assert s["imports"]["unresolved"] == 3 and 0 < s["ref_rate"] < 1


def test_partitions_do_not_matter(spark, tmp_path):
    scan = scan_tree(spark, str(write(tmp_path, SMALL))).cache()
    dumps = []
    for n in (1, 5):
        rows = scan.repartition(n, F.rand(n))
        parsed = extract(rows).cache()
        facts = fact_tables(rows, parsed)
        dumps.append({k: sorted(map(str, v.collect())) for k, v in (facts | derive(facts)).items() if k != "_stage"})
    assert dumps[0] == dumps[1]


def test_doctor_is_content(built):
    rows = {r["code"]: r for r in examine(built).collect()}
    assert not [c for c, r in rows.items() if r["severity"] == "error"], rows
    assert rows["FILES_CONSISTENCY"]["n"] == 0 and rows["SNAPSHOT_ID"]["severity"] == "ok"


def test_doctor_finds_faults(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    incremental.build(index, scan_tree(spark, str(write(tmp_path / "r", SMALL))))
    bad = spark.createDataFrame([("gone.go", "gone.go", "ref_def", 1.0)], TABLES["edges"])
    index.append("derived", {"edges": bad}, spark.createDataFrame([], "path string"), update_in_progress=True, snapshot_id="x")
    index.append("derived", {"bindings": index.read("bindings").limit(0)}, None)
    rows = {r["code"]: r for r in examine(index).collect()}
    assert rows["REFERENTIAL_INTEGRITY_VIOLATIONS"]["n"] >= 2
    assert {"UPDATE_INCOMPLETE", "SNAPSHOT_ID_MALFORMED", "PROJECTION_INCOMPLETE"} <= set(rows)
    assert len(rows["PROJECTION_INCOMPLETE"]["details"]) == 10
    with pytest.raises(IndexProblem):
        index.require_ready()


def test_checks_count_null_as_a_fault(spark):
    rows = [("a", "h", None, "ok"), ("b", None, "too_large", "skipped"), ("c", None, None, "ok"), ("d", "h", "too_large", "ok"), ("e", "h", None, None)]
    files = spark.createDataFrame(rows, "path string, hash string, skip string, parse_status string")
    assert sorted(r["path"] for r in broken_files(files).collect()) == ["c", "d", "e"]


#: What each step changes; null deletes. Bodies, names, new and lost files, packages, manifests, nested modules, vendored code.
EDITS = [
    {"auth/auth.go": FILES["auth/auth.go"].replace("func Login", "func Signin"), "auth/more.go": "package auth\n\nfunc Extra() { Signin(\"z\") }\n"},
    {"util.go": "package main\n\n// Another body.\nfunc helper() int { return 7 }\n"},
    {"dirhelper/h.go": "package renamed\n\nfunc Help() {}\n", "auth/more.go": None},
    {"auth/auth.go": FILES["auth/auth.go"], "auth/auth_test.go": None},
    {"go.mod": "module example.com/other\n"},
    {"go.mod": FILES["go.mod"], "auth/go.mod": "module example.com/auth\n"},
    {"vendor/example.org/dep/dep.go": FILES["vendor/example.org/dep/dep.go"], "auth/go.mod": None},
    {"broken.go": "package main\n\nfunc Fine() { helper() }\n\nfunc Broken( {\n", "notes.md": "notes\n"},
    {"util.go": FILES["util.go"], "dirhelper/h.go": FILES["dirhelper/h.go"], "auth/auth_test.go": FILES["auth/auth_test.go"], "broken.go": None, "notes.md": None, "vendor/example.org/dep/dep.go": None},
]
SMALL = {p: x for p, x in FILES.items() if p.split("/")[0] in ("go.mod", "main.go", "util.go", "auth", "dirhelper")}


def test_incremental_equals_cold(spark, tmp_path):
    """After each step the derived tables are those of all facts; in the end, when all edits are undone, the index is that of a cold build."""
    files = dict(SMALL)
    index, first = Index(spark, str(tmp_path / "live")), Index(spark, str(tmp_path / "cold"))
    incremental.build(index, scan_tree(spark, str(write(tmp_path / "r0", files))))
    for k, edit in enumerate(EDITS, 1):
        files = {p: x for p, x in (files | edit).items() if x is not None}
        root = write(tmp_path / f"r{k}", files)
        run = incremental.update(index, scan_tree(spark, str(root)))
        assert run.added + run.modified + run.deleted == len(edit), k
        assert run.rebuilt_all == (k in (3, 5, 6, 7, 9)), k
        if k in (1, 4):
            whole = derive(index.tables(FACTS))
            for t in DERIVED:
                assert sorted(map(str, index.read(t).collect())) == sorted(map(str, whole[t].collect())), (k, t)
            release(whole)
    incremental.build(first, scan_tree(spark, str(root)))
    strip = lambda rows: [r.split('"mtime"')[0] if '"table":"files"' in r else r for r in rows]
    assert strip(dump(index)) == strip(dump(first)) and index.manifest["snapshot_id"] == first.manifest["snapshot_id"]
    assert incremental.update(index, scan_tree(spark, str(root))).noop


@pytest.mark.parametrize("at", ["_publish", "create", "conflict"])
def test_a_crash_while_saving_leaves_the_old_manifest(spark, tmp_path, monkeypatch, at):
    """Between any two operations on files; and the second of two writers fails."""
    index = Index(spark, str(tmp_path / "i"))
    index.save(snapshot_id="old")
    if at == "conflict":
        other = Index(spark, index.path)
        other.save(snapshot_id="other")
        with pytest.raises(IndexProblem):
            index.save(snapshot_id="new")
        with pytest.raises(IndexProblem):
            index.step("empty", "building")
        assert Index(spark, index.path).manifest["snapshot_id"] == "other"
        return

    def crash(*_, **__):
        raise OSError("cut off")

    if at == "_publish":
        monkeypatch.setattr(Index, "_publish", crash)
    else:
        monkeypatch.setattr("codeloom.plans.store.json.dumps", crash)
    with pytest.raises(OSError):
        index.save(snapshot_id="new")
    monkeypatch.undo()
    again = Index(spark, index.path)
    assert again.manifest["snapshot_id"] == "old"
    again.save(snapshot_id="new")
    again.sweep()
    assert Index(spark, index.path).manifest["snapshot_id"] == "new" and len(again._numbers()) == 1


def test_torn_update_heals(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"))
    incremental.build(index, scan_tree(spark, str(write(tmp_path / "a", SMALL))))
    root = write(tmp_path / "b", SMALL | {"util.go": "package main\n\nfunc helper() {}\n"})

    def crash(*_):
        raise OSError("cut off")

    monkeypatch.setattr(incremental, "affected_files", crash)
    with pytest.raises(OSError):
        incremental.update(index, scan_tree(spark, str(root)))
    monkeypatch.undo()
    again = Index(spark, str(tmp_path / "i"))
    assert again.manifest["update_in_progress"]
    assert incremental.update(again, scan_tree(spark, str(root))).rebuilt_all
    again.require_ready()


def test_resume(spark, tmp_path):
    scan = scan_tree(spark, str(write(tmp_path / "r", SMALL)))
    index = Index(spark, str(tmp_path / "i"))
    index.step("empty", "building")
    facts = fact_tables(scan, extract(scan))
    index.append("facts", {t: facts[t].filter("path < 'm'") for t in FACTS if t != "packages"}, None)
    incremental.bring_up(Index(spark, str(tmp_path / "i")), scan)
    cold = Index(spark, str(tmp_path / "c"))
    incremental.build(cold, scan)
    assert dump(Index(spark, str(tmp_path / "i"))) == dump(cold)


def test_stream_batch_is_an_update(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    scan = scan_tree(spark, str(write(tmp_path / "r", SMALL))).cache()
    apply_changes(index, scan)
    gone = scan.filter("path = 'util.go'").withColumn("size", F.lit(-1).cast("long"))
    run = apply_changes(index, gone)
    assert (run.deleted, run.modified, run.added) == (1, 0, 0)
    assert apply_changes(index, gone).noop


def test_a_store_is_scanned_like_a_tree(spark, tmp_path):
    """By Spark's reader alone: ignore files, pruned folders, bands, hashes and caps."""
    files = SMALL | {".gitignore": "*.log\n/build/\n", "auth/.gitignore": "secret.txt\n!keep.log\n", "a.log": "x", "auth/keep.log": "y", "auth/secret.txt": "z", "build/out.go": "package out\n", ".git/config": "c", "deep/build/in.go": "package in\n", "big.txt": "x" * (1 << 20) + "y"}
    root = str(write(tmp_path, files))
    seen = scan_tree(spark, root).filter("NOT path RLIKE '(^|/)[.]'")  # Spark's readers do not show hidden files
    tree, store = (sorted(map(str, df.drop("mtime").collect())) for df in (seen, scan_store(spark, root)))
    assert tree == store and len(tree) == len(SMALL) + 3
    with pytest.raises(CapExceeded):
        scan_store(spark, root, max_files=3)
    incremental.build(Index(spark, str(tmp_path / "i")), scan_store(spark, root, "*.go"))


def test_life_cycle_is_guarded(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    with pytest.raises(IndexProblem):
        incremental.update(index, spark.createDataFrame([], TABLES["files"]))
    index.save(schema_version=99)
    with pytest.raises(IndexProblem):
        index.check_open()
