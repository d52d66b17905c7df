"""Scalars, task parser, seeds, walk, levels, fit, rendering and scan."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeloom import queries
from codeloom.functions import paths, text
from codeloom.operators import levels, seed, task, walk
from codeloom.sources.scan import CapExceeded, discover, ignored, rules_of, scan_tree


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_path_scalars(spark):
    lit = F.lit
    assert one(spark, *(paths.dir_of(lit(p)) for p in ("a/b/c.go", "c.go", ""))) == ("a/b", "", "")
    assert one(spark, *(paths.resolve_relative(lit(a), lit(b)) for a, b in (("a/b", "../c"), ("a", "../../c"), ("", "./x")))) == ("a/c", None, "x")
    assert one(spark, *(paths.default_qualifier(lit(p)) for p in ("x.org/lib/v2", "v3", "math/rand"))) == ("lib", "v3", "rand")
    assert one(spark, *(paths.internal_violation(lit(a), lit(b)) for a, b in (("deep/user", "deep/internal/fs"), ("outside", "deep/internal/fs"), ("x", "internal/y"), ("deep", "deep/internal")))) == (False, True, False, False)
    assert one(spark, paths.module_path(lit("// c\nmodule \"a.b/c\" // d\n")), paths.module_path(lit("go 1\n"))) == ("a.b/c", None)
    assert one(spark, *(paths.language(lit(p)) for p in ("a/go.mod", "B.GO", "x.rs", "README", "t.cts", "a.b/c"))) == ("go", "go", "unsupported", "unknown", "typescript", "unknown")
    assert one(spark, *(paths.size_band(lit(n)) for n in (1 << 20, (1 << 20) + 1, (50 << 20) + 1))) == (None, "parse_skipped", "too_large")


def test_text_scalars(spark):
    lit = F.lit
    assert one(spark, text.split_camel(lit("parseHTMLString2Foo"))) == (["parse", "HTML", "String2", "Foo"],)
    assert task.camel_parts("parseHTMLString2Foo") == ["parse", "HTML", "String2", "Foo"]
    assert one(spark, text.qualified_parts(lit("auth.Login")), text.qualified_parts(lit("a.b"))) == (["auth", "Login"], None)
    assert one(spark, text.fts_tokens(lit("Remember_Me Élan x-y"))) == (["remember", "me", "elan", "x", "y"],)
    assert one(spark, text.ref_weight(lit(1)), text.ref_weight(lit(3))) == (0.16666666666666666, 0.26111648393354675)


def terms(s):
    return {t["lower"]: t["originals"] for t in task.parse(s)["terms"]}


def test_task_parser():
    assert "rememberme" in terms("remember_me") and terms("remember_me")["rememberme"] == ["remember_me"]
    assert "auth" not in terms("auth") and "auth" in terms("authHandler")
    p = task.parse("look at internal/session.go:42 and `loginUser` or \"bad token\" in pkg.DoIt, flaky config")
    assert p["hints"]["paths"] == ["internal/session.go"] and p["hints"]["verbatim_ident"] == ["loginUser"] and p["hints"]["verbatim_content"] == ["bad token"]
    assert "pkg.DoIt" in p["hints"]["symbols"] and p["flags"] == {"test_bias": True, "config_bias": True}
    assert task.parse(None)["terms"] == []


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [("auth/session.go", "Login", "func"), ("auth/other.go", "login", "func"), ("auth/login.go", "LoginHandler", "func"), ("x/y.go", "Session", "struct"), ("x/z.go", "Zed", "func"), ("x/z.go", "Café", "var")]
    return spark.createDataFrame([(p, i, n, k) for i, (p, n, k) in enumerate(rows)], "path string, start_byte int, name string, kind string").cache()


def term_rows(spark, *words):
    return spark.createDataFrame([("t", w.lower(), [w]) for w in words], "task_id string, term string, originals array<string>")


def test_exact_names(spark, symbols):
    got = {(r["name"], r["score"]) for r in seed.exact_names(symbols, term_rows(spark, "Login")).collect()}
    assert {(n, round(s, 9)) for n, s in got} == {("Login", 3.0), ("login", 2.1)}


def test_bm25_is_that_of_sqlite(spark, symbols):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE s USING fts5(name, file, kind, tokenize='unicode61')")
    for r in symbols.orderBy("start_byte").collect():
        db.execute("INSERT INTO s VALUES (?, ?, ?)", (r["name"], r["path"], r["kind"]))
    for word in ("login", "auth", "session", "cafe", "func"):
        want = sorted(round(-b / (-b + 3), 9) for (b,) in db.execute("SELECT bm25(s) FROM s WHERE s MATCH ?", (f'"{word}"',)) if -b > 0)
        got = sorted(round(r["score"], 9) for r in seed.bm25_names(symbols, term_rows(spark, word)).collect())
        assert got == want, word


def test_names_and_totals(spark):
    files = spark.createDataFrame([("auth/session.go",), ("auth/auth/x.go",), ("authority.go",)], "path string")
    got = {(r["path"], r["signal"]): r["score"] for r in seed.file_names(files, term_rows(spark, "auth", "session")).collect()}
    assert got == {("auth/session.go", "S2"): 2.0, ("auth/session.go", "S3"): 0.5, ("auth/auth/x.go", "S3"): 0.5, ("authority.go", "S2"): 1.2}
    rows = seed.totals(seed.file_names(files, term_rows(spark, "auth", "session"))).collect()
    assert {r["path"]: r["seed"] for r in rows}["auth/session.go"] == 2.5 / 4.5


def test_walk(spark):
    edges = spark.createDataFrame([("a", "b", "import_out", 0.6), ("b", "c", "ref_def", 0.2), ("a", "t", "test_affinity", 0.7)], "src string, dst string, kind string, weight double")
    seeds = spark.createDataFrame([("x", "a", 0.8), ("x", "z", 0.01)], "task_id string, path string, seed double")
    got = {r["path"]: r for r in walk.walk(seeds, walk.traversal(edges, test_bias=True)).collect()}
    b = 0.8 * 0.6 * 0.5
    assert got["b"]["prop"] == pytest.approx(b)
    assert got["c"]["prop"] == pytest.approx(b * 0.2 * 0.5)
    assert got["t"]["prop"] == pytest.approx(0.8 * 0.7 * 1.25 * 0.5)
    assert got["a"]["prop"] == pytest.approx(b * 0.45 * 0.5)
    x = 0.8 + 0.8 * got["a"]["prop"]
    assert got["a"]["total"] == pytest.approx(x / (x + 2))


def test_levels(spark):
    rows = [("t", "a.go", 0.8, "code"), ("t", "a_test.go", 0.01, "code"), ("t", "b.yaml", 0.9, "config"), ("t", "c.go", 0.45, "code"), ("t", "d.sql", 0.9, "data")]
    totals = spark.createDataFrame(rows, "task_id string, path string, total double, role string")
    edges = spark.createDataFrame([("a.go", "a_test.go", "test_affinity", 0.7)], "src string, dst string, kind string, weight double")
    named = spark.createDataFrame([("t", "c.go")], "task_id string, path string")
    got = {r["path"]: r["level"] for r in levels.assign(totals, edges, named).collect()}
    assert got == {"a.go": 5, "a_test.go": 4, "b.yaml": 3, "c.go": 3, "d.sql": 4}


@pytest.mark.parametrize("budget", [60, 200, 1000, 10_000])
def test_fit_stays_in_the_budget(budget):
    files = [{"path": f"f{i}", "total": 1 / (i + 1), "level": 5, "cost": {0: 0, 1: 2, 2: 10, 3: 40, 4: 90, 5: 200}} for i in range(12)]
    got = levels.fit(files, budget)
    assert sum(files[0]["cost"][v] for v in got.values()) <= budget - math.ceil(budget * 8 / 100)
    assert got["f0"] >= got["f11"]
    with pytest.raises(levels.ImpossibleBudget):
        levels.fit(files, 20, frozenset(f["path"] for f in files))


def plain_fit(files, budget):
    """The greedy fit, looking at every file in every round."""
    room, level, by = budget - -(-budget * 8 // 100), {f["path"]: f["level"] for f in files}, {f["path"]: f for f in files}
    cost = lambda p, at: by[p]["cost"].get(at, 0)
    total = sum(cost(p, at) for p, at in level.items())
    while total > room:
        gain = lambda p: (cost(p, level[p]) - cost(p, levels._DOWN[level[p]])) / (max(by[p]["total"], 1e-12) * levels.LOSS[level[p]])
        p = min((p for p in level if level[p] >= 1), key=lambda p: (-gain(p), p))
        total, level[p] = total - cost(p, level[p]) + cost(p, levels._DOWN[level[p]]), levels._DOWN[level[p]]
    while total <= room - -(-budget * 5 // 100):
        steps = [(-by[p]["total"] / max(d, 1), p, d) for p in level if level[p] < by[p]["level"] for d in [cost(p, levels._UP[level[p]]) - cost(p, level[p])] if total + d <= room]
        if not steps:
            break
        _, p, d = min(steps)
        total, level[p] = total + d, levels._UP[level[p]]
    return level


def test_fit_equals_the_plain_one():
    import random

    draw = random.Random(3)
    for budget in (40, 300, 2000, 9000):
        files = [{"path": f"f{i}", "total": draw.choice([0.0, 0.2, draw.random()]), "level": draw.randint(0, 5), "cost": {k: draw.randint(0, 30 * k * k) for k in range(1, 6)}} for i in range(150)]
        assert levels.fit(files, budget) == plain_fit(files, budget)


def test_budget_fit_gives_every_document_a_level(spark):
    rows = [("hot", 100 + i % 97 * 50) if i % 3 else ("cold", 5000 + i) for i in range(900)]
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, n_chars long")
    got = {(r["task_id"], int(r["path"])): r["level"] for r in queries.budget_fit_of(docs).collect()}
    assert set(got) == {(s, i) for i, (s, _) in enumerate(rows)}
    for source in ("hot", "cold"):
        files = []
        for i, (s, n) in enumerate(rows):
            total = n / (n + 4000)
            if s == source:
                files.append({"path": str(i), "total": total, "level": next((v for least, v in levels.BANDS if total >= least), 0), "cost": {k: math.ceil(n * m / 4000) for k, m in enumerate((0, 1, 20, 100, 400, 1000))}})
        assert {p: v for (s, p), v in got.items() if s == source} == {int(p): v for p, v in plain_fit(files, 4000).items()}


def test_rendering_fences_and_masks():
    rows = [{"path": "a.go", "level": 5, "total": 1.0, "lang": "go", "size": 9, "symbols": []}, {"path": "b.go", "level": 3, "total": 0.5, "lang": "go", "size": 9, "symbols": [{"name": "F", "kind": "func", "line": 1, "end_line": 2, "signature": "func F()", "doc": "Does."}]}, {"path": "c.go", "level": 0, "total": 0.0, "lang": "go", "size": 9, "symbols": []}]
    out = levels.render({"task": "x"}, rows, lambda p: "```\npassword = \"hunter2hunter2\"")
    assert "````" in out and "hunter2" not in out and "func F()" in out and "1 files excluded" in out


class FakeIndex:
    def __init__(self, spark, tables):
        self.spark, self.tables, self.manifest = spark, tables, {"snapshot_id": "x"}

    def require_ready(self):
        pass

    def read(self, name):
        return self.tables[name]


def test_selection_keeps_all_files_with_a_level_and_all_forced_ones(spark):
    from codeloom.plans import select

    ranked = spark.createDataFrame([("task", f"a{i:03}.go", 0.2, 1) for i in range(300)] + [("task", f"z{i:03}.sql", 0.0, 0) for i in range(300)], "task_id string, path string, total double, level int")
    assert {r["path"] for r in select.candidates(ranked, ["z*.sql"]).collect()} == {r["path"] for r in ranked.collect()}
    assert select.candidates(ranked, []).count() == 300
    files = spark.createDataFrame([(f"f{i:03}.go", "go", 30) for i in range(400)], "path string, lang string, size long").coalesce(1)
    edges = spark.createDataFrame([("f000.go", f"f{i:03}.go", "import_out", 0.6) for i in range(1, 350)], "src string, dst string, kind string, weight double").coalesce(1)
    symbols = spark.createDataFrame([], "path string, start_byte int, name string, kind string, line int, end_line int, signature string, doc string")
    plan = select.select(FakeIndex(spark, {"files": files, "edges": edges, "symbols": symbols}), "", 100_000)
    assert plan.mode == "map" and len(plan.rows) + plan.excluded == 400 and sum(r["level"] == 3 for r in plan.rows) == 400
    assert sum(r["total"] > 0 for r in plan.rows) == 349
    assert "7 files excluded" in levels.render({}, [], str, 7)


def test_ignore_rules():
    rules = rules_of("*.log\n!keep.log\n/build/\ndocs/**/x\n# c\n", "")
    assert [ignored(p, d, rules) for p, d in (("a/b.log", False), ("keep.log", False), ("build", True), ("a/build", True), ("docs/1/2/x", False))] == [True, False, True, False, True]


def test_scan(spark, tmp_path):
    for path, body in {".gitignore": "skip/\n", "skip/a.go": "x", "b/.hidden.go": "package b\n", "a-b/x.go": "", "a.go": "", ".git/config": "z"}.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    (tmp_path / "link.go").symlink_to(tmp_path / "a.go")
    assert [p for p, *_ in discover(str(tmp_path))] == [".gitignore", "a-b/x.go", "a.go", "b/.hidden.go"]
    got = {r["path"]: r for r in scan_tree(spark, str(tmp_path)).collect()}
    assert got["a.go"]["hash"] == got["a-b/x.go"]["hash"] and got["a.go"]["lang"] == "go"
    with pytest.raises(CapExceeded):
        discover(str(tmp_path), max_files=2)
    with pytest.raises(OSError):
        discover(str(tmp_path / "none"))


def test_worked_task():
    got = terms("users get logged out; remember_me in authentication has a timeout")
    assert sorted(got) == ["authentication", "logged", "out", "remember", "rememberme", "timeout", "users"]
