"""Seed scores of files for tasks: exact names, BM25, names of files and directories, densities."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import stem_of
from codeloom.functions.text import TOKEN, bm25_term, density, fold, folded_regex, fts_tokens, saturate, token_count
from codeloom.plans.stage import Stage

WEIGHTS = {"S1": 3.0, "S2": 2.0, "S3": 1.0, "S4": 1.0, "S5": 0.5, "S6": 0.5, "S7": 0.0, "S8": 1.0, "S9": 10.0}
KAPPA, FLOOR, CANDIDATES = 2.0, 0.05, 2000


def matches(rows: DataFrame, keys: list[str], terms: DataFrame, *cols: Column) -> DataFrame:
    """(keys, hits, len): how often each searched token stands in a row over all its columns; counted inside the row.

    ``terms``, of a few tasks, is gathered into one array and one regular expression that ride along with each row. Tokens of
    all rows are only counted; where the expression finds nothing, none is made, folded or compared.
    """
    tokens = terms.select(fold(F.col("term")).alias("token")).filter(F.col("token").rlike(f"^{TOKEN}$"))
    wanted = tokens.agg(F.array_sort(F.collect_set("token")).alias("tokens"), folded_regex(F.collect_set("token")).alias("regex"))
    whole = wanted.select(F.struct("tokens", "regex")).scalar()
    texts = [F.coalesce(c, F.lit("")) for c in cols]
    some = functools.reduce(lambda a, b: a | b, (F.regexp_instr(F.lower(c), F.col("wanted.regex")) > 0 for c in texts))
    rows = rows.withColumn("wanted", whole)
    found = F.array_sort(F.filter(F.concat(*map(fts_tokens, texts)), lambda t: F.array_contains("wanted.tokens", t)))
    found = rows.select(*keys, functools.reduce(lambda a, b: a + b, map(token_count, texts)).alias("len"), F.when(some, found).otherwise(F.array().cast("array<string>")).alias("found"))
    count = lambda w: F.struct(w.alias("token"), F.size(F.filter("found", lambda t: t == w)).cast("long").alias("f"))
    return found.select(*keys, "len", F.transform(F.array_distinct("found"), count).alias("hits"))


def bm25(rows: DataFrame, keys: list[str], terms: DataFrame, *cols: Column, stage: Stage | None = None) -> DataFrame:
    """(task_id, term, keys, b) of rows that hold a term; every row counts in the statistics, with or without tokens.

    Only the row count, the mean length and the document frequencies of the terms are aggregated, combined before each shuffle;
    rows without a term are dropped where they are read. With ``stage``, each row's counts are kept there, so that texts are read
    and split once; without it, once for each of the three.
    """
    found = matches(rows, keys, terms, *cols)
    if stage is not None:
        found = stage.keep(found, "matches")
    whole = found.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("mean")).alias("whole"))
    each = found.filter(F.size("hits") > 0).select(*keys, "len", F.explode("hits").alias("h")).select(*keys, "len", "h.token", "h.f")
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    named = terms.select("task_id", "term", fold(F.col("term")).alias("token")).join(df, "token").withColumn("whole", whole.scalar())
    hit = each.join(F.broadcast(named), "token")  # a task has few terms
    return hit.select("task_id", "term", *keys, bm25_term(F.col("whole.n"), F.col("df"), F.col("f"), F.col("len"), F.coalesce("whole.mean", F.lit(1.0))).alias("b"))


def exact_names(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """S1: (task_id, path, name, term, score, signal), one row per term and symbol.

    A name equal to a spelling of the task counts 1, one equal but for case 0.7. A name that the tokenizer
    splits is never reached, as a term is one token.
    """
    whole = F.size(fts_tokens(F.col("name"))) == 1
    named = symbols.filter(whole).select("path", "name", F.get(fts_tokens(F.col("name")), F.lit(0)).alias("token"))
    hit = named.join(terms.select("task_id", "term", "originals", fold(F.col("term")).alias("token")), "token")
    exact, folded = F.array_contains("originals", F.col("name")), F.lower("name") == F.col("term")
    value = F.when(exact, 1.0).when(folded, 0.7)
    return hit.filter(exact | folded).select("task_id", "path", "name", "term", (F.lit(WEIGHTS["S1"]) * value).alias("score"), F.when(exact, "S1Exact").otherwise("S1Folded").alias("signal"))


def bm25_names(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """S4: (task_id, path, term, score), one row per term and symbol row, not summed; b / (b + 3)."""
    rows = symbols.select("path", "start_byte", "name", "kind")
    scored = bm25(rows, ["path", "start_byte", "name"], terms, F.col("name"), F.col("path"), F.col("kind")).filter("b > 0")
    return scored.select("task_id", "path", "term", (F.lit(WEIGHTS["S4"]) * F.col("b") / (F.col("b") + 3)).alias("score"))


def file_names(files: DataFrame, terms: DataFrame) -> DataFrame:
    """S2 and S3: (task_id, path, signal, score). A stem equal to a term counts 1, one that holds it 0.6, the best of all terms; each matching directory 0.5, up to 1."""
    each = files.select("path", F.lower(stem_of(F.col("path"))).alias("stem"), F.explode(F.array_distinct(F.split(F.lower("path"), "/"))).alias("segment"))
    names = files.select("path", F.lower(stem_of(F.col("path"))).alias("stem"))
    few = F.broadcast(terms.select("task_id", "term"))  # a task has few terms
    stem = names.join(few, F.contains(F.col("stem"), F.col("term"))).groupBy("task_id", "path").agg(F.max(F.when(F.col("stem") == F.col("term"), 1.0).otherwise(0.6)).alias("v"))
    dirs = each.join(few, F.col("segment") == F.col("term")).groupBy("task_id", "path").agg(F.least(F.lit(1.0), F.countDistinct("segment") * 0.5).alias("v"))
    parts = [df.select("task_id", "path", F.lit(s).alias("signal"), (F.lit(WEIGHTS[s]) * F.col("v")).alias("score")) for s, df in (("S2", stem), ("S3", dirs))]
    return parts[0].unionByName(parts[1])


def densities(contents: DataFrame, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """S5 and S6: (task_id, path, signal, score) from (path, content, docs) of each task's 2,000 best candidates (task_id, path, score)."""
    best = Window.partitionBy("task_id").orderBy(F.desc("score"), "path")
    top = candidates.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= CANDIDATES).select("task_id", "path")
    words = contents.join(top.select("path").distinct(), "path", "left_semi")
    out = []
    for signal, col, divisor in (("S5", "content", 8.0), ("S6", "docs", 4.0)):
        each = matches(words, ["path"], terms, F.col(col)).select("path", F.explode("hits").alias("h")).select("path", "h.token", "h.f")
        found = each.join(terms.select("task_id", fold(F.col("term")).alias("token")), "token")
        hits = found.join(top, ["task_id", "path"]).groupBy("task_id", "path").agg(F.sum("f").alias("hits"))
        out.append(hits.select("task_id", "path", F.lit(signal).alias("signal"), (F.lit(WEIGHTS[signal]) * density(F.col("hits"), divisor)).alias("score")))
    return out[0].unionByName(out[1])


def totals(signals: DataFrame) -> DataFrame:
    """(task_id, path, x, seed) from (task_id, path, score): added in the order of the scores, so that every run gives the same bits."""
    summed = F.aggregate(F.array_sort(F.collect_list("score")), F.lit(0.0), lambda a, b: a + b)
    return signals.groupBy("task_id", "path").agg(summed.alias("x")).withColumn("seed", saturate(F.col("x"), KAPPA))


def in_map_mode(seeds: DataFrame) -> bool:
    """Whether no file reaches the floor, so that the task says nothing about this code."""
    return seeds.filter(F.col("seed") >= FLOOR).isEmpty()
