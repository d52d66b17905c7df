"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
for each rule that failed; a policy is a mask of enforced rules, so applying a policy, comparing
versions and ablating rules are bitwise operations on one long and never touch texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_SPACE = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_STARTS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
_LETTERS = np.array([chr(b).isalpha() if b < 128 else _STARTS[b] for b in range(256)])

#: Rules in the order of their bits; true is a failure. Integer arithmetic only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "few_letters": "2 * n_letters < word_chars",
}


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


BASE = mask("few_words", "repeated_windows")
#: Enforced rules by version; the base rules are in each.
POLICIES = {"v1": BASE, "v2": BASE | mask("short_words", "long_words", "symbols", "repeated_lines"), "v3": mask(*RULES)}
CURRENT = "v3"


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (own[j : j + n] ^ (own[j : j + n] >> np.uint64(29)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
    mine = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, ref = order[mine], order[first[mine]]
    if all((own[at + j] == own[ref + j]).all() for j in range(WINDOW)) and len(set(words)) == len(np.unique(own)):
        starts = at
    else:  # a collision of hashes: compare the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
        starts = np.array([i for x in seen.values() if len(x) > 1 for i in x], np.int64)
    edge = np.bincount(starts, minlength=len(words) + WINDOW) - np.bincount(starts + WINDOW, minlength=len(words) + WINDOW)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    count = np.zeros(256, np.int64)
    for k in range(0, len(text), 1 << 22):
        count += np.bincount(np.frombuffer(text, np.uint8, min(1 << 22, len(text) - k), k), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(count[_STARTS].sum() - count[_SPACE].sum())
    return len(words), chars, int(count[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeated(words), len(lines), int(count[_LETTERS].sum())


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the measures, then the columns named in ``keep`` as kept_0, ...), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES))), *batch.columns[2:]], [*_SCHEMA.names, *batch.schema.names[2:]])

    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *kept)
    extra = "".join(f", {c} {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + extra)


def ledger(measured: DataFrame) -> DataFrame:
    """Adds fail_bits; each rule is evaluated once."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy version."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return entries.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(POLICIES[policy] | BASE))


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(policy, rule, n_failed, n_only, kept_without): what each enforced rule rejects, alone too.

    The ledger is first reduced to counts by bit pattern (at most 2^rules rows, combined before the shuffle).
    """
    m = POLICIES[policy]
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    enforced = [(i, r) for i, r in enumerate(RULES) if m >> i & 1]
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enforced)))
    hit = F.col("fail_bits").bitwiseAND(F.lit(m))
    each = patterns.select("n", hit.alias("hit"), rows.alias("r")).select("n", "hit", "r.*")
    return each.groupBy(F.lit(policy).alias("policy"), "rule").agg(
        F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits, ...).

    One row per input row, repeated rows and null ids included. A null or empty text measures 0 everywhere and fails the
    base rule on words. Words are runs without ASCII white space, compared by
    case; lines are split at \\n, and count when they hold a word. Other columns are
    ignored, whatever their names; an empty table gives an empty result. The plan has no shuffle.
    """
    return apply_policy(ledger(measurements(docs, id_col, text_col)), policy)


def passed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, all columns, that the policy keeps."""
    names = docs.columns
    kept = apply_policy(ledger(measurements(docs, id_col, text_col, tuple(names))), policy).filter("kept")
    return kept.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)))
