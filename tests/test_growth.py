"""How often texts are read and split, and the cheaper forms against the plain ones."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codeloom import queries
from codeloom.functions import text
from codeloom.operators import seed
from codeloom.plans.derive import derive, release
from codeloom.plans.stage import Stage
from codeloom.sources import golang
from codeloom.sources.facts import extract, fact_tables
from codeloom.sources.synth import synthetic_scan

ODD = ["", None, "Remember_Me Élan x-y", "  élan ELAN\n", "ŒUVRE İstanbul 42 ４２ ǅ", "elan", "elan's elanx x_elan\r\n", "\U0001d400\U0001d401 elan", "ýÿā.ąš ñ"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_matches_are_those_of_all_tokens_folded(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    terms = spark.createDataFrame([("task", w, [w]) for w in ("Élan", "42", "yya", "x.y", "")], "task_id string, term string, originals array<string>")
    for cols in ([F.col("t")], [F.col("t"), F.col("t")]):
        tokens = F.concat(*(text.fts_tokens(F.coalesce(c, F.lit(""))) for c in cols))
        want = {r["id"]: (len(r["k"]), {w: r["k"].count(w) for w in ("elan", "42", "yya") if w in r["k"]}) for r in rows.select("id", tokens.alias("k")).collect()}
        got = {r["id"]: (r["len"], {h["token"]: h["f"] for h in r["hits"]}) for r in seed.matches(rows, ["id"], terms, *cols).collect()}
        assert got == want
        assert sum(len(h) for _, h in got.values()) > 4
    assert all(not r["hits"] for r in seed.matches(rows, ["id"], terms.limit(0), F.col("t")).collect())


def test_bm25_reads_and_splits_texts_once(spark, tmp_path):
    docs = documents(spark, tmp_path)
    for name in ("bm25_documents", "seed_topk_documents"):
        got = queries.QUERIES[name](spark, docs)
        assert not re.search(r"split\(|regexp|text#", plan(got)), name
    df, terms = spark.read.parquet(f"{docs}/documents.parquet"), queries._terms(spark, ["elan", "42"])
    stage = Stage(spark)
    kept, lazy = seed.bm25(df, ["doc_id"], terms, F.col("text"), stage=stage), seed.bm25(df, ["doc_id"], terms, F.col("text"))
    assert kept.count() == 6 and sorted(kept.collect()) == sorted(lazy.collect())
    stage.release()


def test_camel_split_makes_words_once_and_splits_all_lines_at_once(spark, tmp_path):
    got = queries.camel_split(spark, documents(spark, tmp_path))
    assert plan(got).count("array_distinct(") == 1
    assert len(re.findall(r"split\(", plan(got))) == 2 and "flatten" not in plan(got)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()}[2] == (2, 8, 8)


def test_camel_parts_of_lines_are_those_of_each_line(spark):
    words = ["parseHTMLString2Foo", "ÉlanVITAL", "ǅAb", "aBC", "ABc", "x4X", "日本Ab", "éÉé", "A", "aA", "HTTPId", "\U0001d400b"]
    plain = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    rows = spark.createDataFrame([(words,)], "w array<string>")
    want, one, lines = rows.select(F.flatten(F.transform("w", lambda w: F.split(w, plain))), F.flatten(F.transform("w", text.split_camel)), text.split_camel_lines(F.array_join("w", "\n"))).first()
    assert want == one == lines and len(want) > len(words)


def test_scanner_takes_no_step_for_white_space():
    assert [(m.lastgroup, m[m.lastindex]) for m in golang._TOKEN.finditer("a  b\tc  ")][:4] == [("name", "a"), ("name", "b"), ("name", "c"), ("end", "")]
    assert golang.parse(b"package a  \n \t\nfunc F() { @ }\n\nfunc G() {}  ").status == "partial"


def test_references_are_judged_after_one_exchange(spark, monkeypatch):
    kept = {}
    keep = Stage.keep
    monkeypatch.setattr(Stage, "keep", lambda self, df, name: kept.setdefault(name, df) and keep(self, df, name))
    scan = synthetic_scan(spark, 30)
    parsed = keep(Stage(spark), extract(scan), "parsed")
    facts = fact_tables(scan, parsed)
    facts["refs"] = facts["refs"].union(facts["refs"])  # each reference twice in the facts: as many bindings, targets once
    out = derive(facts)
    assert set(kept) == {"files", "manifests", "resolved", "defs", "rows", "bindings"}
    assert out["bindings"].count() == facts["refs"].count()
    assert out["binding_targets"].count() == out["binding_targets"].distinct().count() > 0
    assert {r["kind"]: r["count"] for r in out["edges"].groupBy("kind").count().collect()} == {"import_out": 200, "ref_def": 20}
    release(out)
