"""Task text to terms, hints and flags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import CONFIG_WORDS, MIN_TERM, STOPWORDS, TEST_WORDS

SCHEMA = (
    "struct<terms:array<struct<lower:string,originals:array<string>>>,"
    "hints:struct<symbols:array<string>,paths:array<string>,verbatim_ident:array<string>,verbatim_content:array<string>>,"
    "flags:struct<test_bias:boolean,config_bias:boolean>>"
)
_EXTENSION = re.compile(r"\.(?:cs|go|java|js|py|rs|ts|tsx)$", re.IGNORECASE)
_LINE = re.compile(r":[0-9]+$")


def camel_parts(run: str) -> list[str]:
    out, start = [], 0
    for i in range(1, len(run)):
        a, b = run[i - 1], run[i]
        turn = (a.islower() or a.isnumeric()) and b.isupper()
        turn |= a.isupper() and b.isupper() and run[i + 1 : i + 2].islower()
        if turn:
            out.append(run[start:i])
            start = i
    return [*out, run[start:]] if run else []


def _runs(s: str) -> list[str]:
    return "".join(c if c.isalnum() else "\0" for c in s).split("\0")


def _too_short(s: str) -> bool:
    return len(s) < MIN_TERM or s[0].isnumeric()


def _spans(task: str) -> tuple[set[str], set[str]]:
    """Contents of back quotes, and of double quotes; an open one runs to the end."""
    found: dict[str, set[str]] = {"`": set(), '"': set()}
    at = 0
    while m := re.compile('[`"]').search(task, at):
        end = task.find(m[0], m.end())
        found[m[0]].add(task[m.end() : end if end >= 0 else len(task)].strip())
        if end < 0:
            break
        at = end + 1
    return found["`"] - {""}, found['"'] - {""}


class _Parser:
    def __init__(self) -> None:
        self.terms: dict[str, set[str]] = {}
        self.flags = {"test_bias": False, "config_bias": False}

    def modifier(self, word: str) -> bool:
        """Flags a modifier word, which is then no term."""
        word = word.lower()
        self.flags["test_bias"] |= word in TEST_WORDS
        self.flags["config_bias"] |= word in CONFIG_WORDS
        return word in TEST_WORDS or word in CONFIG_WORDS

    def add(self, piece: str, original: str) -> None:
        self.terms.setdefault(piece.lower(), set()).add(original)

    def word(self, piece: str, original: str) -> None:
        if not _too_short(piece) and piece.lower() not in STOPWORDS:
            self.add(piece, original)

    def fragment(self, piece: str) -> None:
        """Part of an identifier: stop words count, modifiers do not."""
        if not self.modifier(piece) and not _too_short(piece):
            self.add(piece, piece)

    def token(self, token: str, is_path: bool) -> None:
        runs = _runs(token)
        for run in runs:
            pieces = camel_parts(run)
            for piece in pieces:
                if is_path or (len(runs) == 1 and len(pieces) == 1):
                    self.word(piece, piece)
                else:
                    self.fragment(piece)
        joined = len(runs) > 1 and all(runs) and ("_" in token or "-" in token) and any(map(_too_short, runs))
        if joined and not self.modifier("".join(runs)):
            self.word("".join(runs), token)


def parse(task: str | None) -> dict:
    """One task; null is empty."""
    task = task or ""
    p, symbols, paths = _Parser(), set(), set()
    for raw in task.split():
        token = raw
        while token and not (token[0].isalnum() or token[0] == "/"):
            token = token[1:]
        while token and not (token[-1].isalnum() or token[-1] == "/"):
            token = token[:-1]
        token = _LINE.sub("", token)
        if not token:
            continue
        p.modifier(token)
        parts = [x for x in re.split("[.:]", token) if x]
        if "/" in token or _EXTENSION.search(token):
            paths.add(token)
            p.token(token, True)
        elif len(parts) > 1 and all(len(x) > 1 and x[0].isalpha() for x in parts):
            symbols.add(token)
            symbols.update(x for x in parts if x.lower() not in STOPWORDS)
            p.fragment(parts[-1])
        else:
            p.token(token, False)
    ident, content = _spans(task)
    return {
        "terms": [{"lower": k, "originals": sorted(v)} for k, v in sorted(p.terms.items())],
        "hints": {"symbols": sorted(symbols), "paths": sorted(paths), "verbatim_ident": sorted(ident), "verbatim_content": sorted(content)},
        "flags": p.flags,
    }


_ARROW = pa.struct(
    [
        ("terms", pa.list_(pa.struct([("lower", pa.string()), ("originals", pa.list_(pa.string()))]))),
        ("hints", pa.struct([(k, pa.list_(pa.string())) for k in ("symbols", "paths", "verbatim_ident", "verbatim_content")])),
        ("flags", pa.struct([("test_bias", pa.bool_()), ("config_bias", pa.bool_())])),
    ]
)


def parse_tasks(tasks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(task_id, parsed) of many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], _ARROW)], ["task_id", "parsed"])

    pair = tasks.select(F.col(id_col).alias("task_id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, f"task_id {pair.dtypes[0][1]}, parsed {SCHEMA}")


def terms_of(parsed: DataFrame) -> DataFrame:
    """(task_id, term, originals): one row per term."""
    return parsed.select("task_id", F.explode("parsed.terms").alias("t")).select("task_id", F.col("t.lower").alias("term"), "t.originals")
