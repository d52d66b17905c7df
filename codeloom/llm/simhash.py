"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d have a point between them that is at most half of d
from either. So when every fingerprint emits all points of its ball of half the radius, each
pair within the radius meets at some point, and no pair is lost.

On 64 bits and radius 4 the ball has 1 + 64 + 2016 = 2081 points. To move less, the
production form splits the word in two halves: a pair within 4 is within 2 in one half,
so it meets in that half's ball of radius 1, with 33 points (66 for both halves). Pairs that
collide there are verified on the full word. A collision group of more than ``dense``
fingerprints is not paired off: its members emit the points of the full-width ball inside
the group, and members that share such a point are within the radius by construction,
so a star to the smallest one stands for all their links. Both forms give the same links'
components; ``whole=True`` is the form on the full word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import components, materialize, union_all

WIDTH, SEED, SHINGLE = 64, 42, 4
_CHUNK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the words' 4-word shingles; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n], starts[min(SHINGLE, len(words)) :][:n] - 1
    ones, digest = np.zeros(WIDTH, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        ends = zip(first[k : k + _CHUNK].tolist(), last[k : k + _CHUNK].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in ends), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's id, and a hash of its text by which rows that share an id are told apart."""
    text = F.col(f"`{text_col}`").cast("binary")
    return F.col(f"`{id_col}`").cast("long"), F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp, and with ``hashed`` the text's hash h): one row per input row, fp the signed form of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    number, h = _identity(docs, id_col, text_col)
    rows = docs.select(number.alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *([h.alias("h")] if hashed else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", h long" * hashed)


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _around(value: Column, width: int, radius: int) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, _ball(width, radius))), lambda m: value.bitwiseXOR(m)))


def _differs(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links of each fingerprint to the smallest that shares its keys."""
    hubs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("hub")).filter("n > 1")
    return rows.join(hubs, keys).filter("fp <> hub").select("hub", F.col("fp").alias("other"))


def near_links(fps: DataFrame, radius: int = 4, dense: int = 256, whole: bool = False) -> DataFrame:
    """Links (hub, other) that connect all ``fps`` (distinct, column fp) within ``radius``, and none beyond it."""
    if radius % 2 or (not whole and radius % 4):
        raise ValueError("the radius must be even, and a multiple of 4 in the split form")
    if whole:
        return _stars(fps.select("fp", _around(F.col("fp"), WIDTH, radius // 2).alias("key")), ["key"])
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)]
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("half"), x.alias("own"), y.alias("rest")) for i, (x, y) in enumerate(zip(halves, halves[::-1], strict=True)))))
    parts = fps.select("fp", parts.alias("p")).select("fp", "p.*")
    near = parts.select("fp", "half", "own", "rest", _around(F.col("own"), 32, radius // 4).alias("key"))
    keys = ["half", "key"]
    # One shuffle: the rows of a point stream past their count, and most points have one row.
    met = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    more = materialize(met.filter("n > 1"), "met")
    few = more.filter(F.col("n") <= dense)
    a = few.select(*keys, F.col("fp").alias("hub"), F.col("own").alias("own_a"))
    b = few.select(*keys, F.col("fp").alias("other"), F.col("own").alias("own_b"))
    on = reduce(Column.__and__, [*(a[k] == b[k] for k in keys), a["hub"] < b["other"], _differs("hub", "other") <= radius])
    if radius == 4:
        # Of the points where a pair meets, one counts: the first one's, its lowest differing bit flipped.
        x = F.col("own_a").bitwiseXOR(F.col("own_b"))
        on &= a["key"] == F.col("own_a").bitwiseXOR(x.bitwiseAND(F.bitwise_not(x) + 1))
    links = [a.join(b, on).select("hub", "other")]
    if not more.filter(F.col("n") > dense).isEmpty():
        many = more.filter(F.col("n") > dense).withColumn("moved", F.bit_count(F.col("own").bitwiseXOR(F.col("key"))))
        links.append(_stars(union_all([many.filter(F.col("moved") == m).select("fp", *keys, _around(F.col("rest"), 32, radius // 2 - m).alias("point")) for m in range(radius // 4 + 1)]), [*keys, "point"]))
    return union_all(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, dense: int = 256, whole: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Words are runs without ASCII white space of the text, A-Z lower-cased. Null and empty texts
    have fingerprint zero and link like any other; a text of fewer than four words has its
    words as its one shingle; bits at exactly half are 0. Rows with equal fingerprints form one class, so copies
    cost one row each and never meet in pairs. component_id is the smallest non-null id of
    the component: a row with a null id keeps its fingerprint and gets the id of what it
    resembles, else null. Repeated rows are kept. Other columns of ``docs`` are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(rows, radius, dense, whole)
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(rows: DataFrame, radius: int, dense: int, whole: bool) -> DataFrame:
    """(fp, least, root): every distinct fingerprint, its smallest id and its component."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), radius, dense, whole), "hub", "other")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, dense: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of the smallest non-null id.

    A component whose ids are all null keeps a row too; of repeated rows of the chosen id one stays.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, True), "fingerprints")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    chosen = _rooted(rows, radius, dense, False).groupBy("root").agg(first).select(F.col("first.least").alias("chosen_id"), F.col("first.fp").alias("chosen_fp"))
    met = rows.join(chosen.hint("merge"), rows["doc_id"].eqNullSafe(chosen["chosen_id"]) & (rows["fp"] == chosen["chosen_fp"]), "left_semi")
    # Texts are read again by what tells their rows apart, and not fingerprinted again.
    marks = materialize(met.groupBy("doc_id", "fp").agg(F.min("h").alias("chosen_h"), F.count(F.lit(1)).alias("n")).withColumnRenamed("doc_id", "chosen_id"), "chosen")
    names = docs.columns
    number, h = _identity(docs, id_col, text_col)
    whole = docs.select(number.alias("own_id"), h.alias("own_h"), *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)))
    kept = whole.join(marks.hint("merge"), whole["own_id"].eqNullSafe(marks["chosen_id"]) & (whole["own_h"] == marks["chosen_h"]), "left_semi")
    if not marks.filter("n > 1").isEmpty():
        one = Window.partitionBy("own_id", "own_h").orderBy(F.xxhash64(*(c for c in kept.columns if c.startswith("kept_"))))
        kept = kept.withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    return kept.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)))
