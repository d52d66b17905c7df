"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. They are rotated to principal
axes (a rotation keeps distances, whatever sample it was fitted on), cut into cells of that
width along the leading ones, and sorted by label and cells. The sorted sequence is cut into
blocks; the pairs of its intervals are refined level by level, from the whole sequence to
blocks, and a pair is dropped as soon as its bounding boxes are provably further
apart than the radius. Inside a pair of blocks the same recursion goes on down to small
squares, which are multiplied in double precision.

Equal vectors of a label form one class, so copies cost one row. A pair of blocks
returns link counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import components, materialize

COSINE = 0.93
#: Rows that fit the rotation; leading axes that are cut into cells; vectors in a block; children of an interval.
SAMPLE, AXES, BLOCK, FANOUT = 4096, 6, 512, 8
_LEAF, _KEY = 64, 32
_SLACK = 1e-9


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (vec_id, key), key null where a vector can link with nothing; and one row (key, label, v, n, least) per class.

    A class is a label and the exact values of a vector.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    # -0.0 and 0.0 are equal, and hash alike once added to 0.0
    key = F.unhex(F.sha2(F.concat_ws("|", F.length("label"), "label", F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256))
    rows = materialize(rows.withColumn("key", F.when(usable, key)), "vectors")
    some = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "key"), materialize(some.withColumn("dim", F.size("v")), "classes")


def _axes(unit: np.ndarray) -> np.ndarray:
    """Principal axes of a sample, as columns."""
    return np.linalg.svd(unit - unit.mean(0), full_matrices=True)[2].T


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _grid(rows: DataFrame, dim: int, axes: np.ndarray, eps: float, k: int) -> DataFrame:
    """Adds the cells along the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.floor(_unit(b["v"], dim) @ axes[:, :k] / eps).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * k, pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, "cells"])

    return rows.mapInArrow(run, "key binary, label string, v array<double>, n long, cells array<int>")


_BLOCKS = "part int, seq int, label string, lo array<double>, hi array<double>, body binary"


def _blocks(rows: DataFrame, dim: int, axes: np.ndarray, size: int) -> DataFrame:
    """Packs each sorted partition into blocks of one label: bounding box along all axes, keys, counts and rotated vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            x = np.concatenate([h[1] for h in held])
            body = b"".join(k for h in held for k in h[2]) + np.concatenate([h[3] for h in held]).tobytes() + x.tobytes()
            row = [[part], [seq], [held[0][0]], [x.min(0).tolist()], [x.max(0).tolist()], [body]]
            seq += 1
            held.clear()
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["part", "seq", "label", "lo", "hi", "body"])

        for b in batches:
            x, labels = _unit(b["v"], dim) @ axes, b["label"].to_pylist()
            keys, n = b["key"].to_pylist(), b["n"].to_numpy()
            k = 0
            while k < len(b):
                if held and (held[0][0] != labels[k] or sum(len(h[1]) for h in held) >= size):
                    yield flush()
                room = size - sum(len(h[1]) for h in held)
                end = k
                while end < len(b) and end - k < room and labels[end] == labels[k]:
                    end += 1
                held.append((labels[k], x[k:end], keys[k:end], n[k:end]))
                k = end
        if held:
            yield flush()

    return rows.mapInArrow(run, _BLOCKS)


def _body(raw: bytes, dim: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    m = len(raw) // (_KEY + 8 * (dim + 1))
    keys = [raw[k : k + _KEY] for k in range(0, _KEY * m, _KEY)]
    return keys, np.frombuffer(raw, np.int64, m, _KEY * m), np.frombuffer(raw, np.float64, offset=(_KEY + 8) * m).reshape(m, dim)


def _squares(x: np.ndarray, y: np.ndarray, same: bool, eps2: float) -> Iterator[tuple[int, int, int, int]]:
    """Recursion into halves of both intervals, without pairs whose boxes are too far apart."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        gap = np.maximum(0, np.maximum(x[a:b].min(0) - y[c:d].max(0), y[c:d].min(0) - x[a:b].max(0)))
        if gap @ gap > eps2:
            continue
        if b - a <= _LEAF and d - c <= _LEAF:
            yield a, b, c, d
            continue
        p, q = (a + b) // 2 if b - a > _LEAF else b, (c + d) // 2 if d - c > _LEAF else d
        stack += [(s, t, u, v) for s, t in ((a, p), (p, b)) for u, v in ((c, q), (q, d)) if s < t and u < v and not (same and v <= s)]


def _links(left: bytes, right: bytes, same: bool, dim: int, cosine: float, eps2: float) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Counts of linked vectors by class, and a spanning forest of the links, of one pair of blocks."""
    na, ca, x = _body(left, dim)
    nb, cb, y = (na, ca, x) if same else _body(right, dim)
    count_a, count_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    root: dict[bytes, bytes] = {}

    def find(i: bytes) -> bytes:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    forest = []
    for a, b, c, d in _squares(x, y, same, eps2):
        hit = x[a:b] @ y[c:d].T >= cosine
        if same:
            hit &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not hit.any():
            continue
        count_a[a:b] += hit @ cb[c:d]
        count_b[c:d] += ca[a:b] @ hit
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = find(na[a + i]), find(nb[c + j])
            if p != q:
                root[max(p, q)] = min(p, q)
                forest.append((max(p, q), min(p, q)))
    counts: dict[bytes, int] = {}
    for nodes, found in ((na, count_a), (nb, count_b)):
        for k in np.flatnonzero(found):
            counts[nodes[k]] = counts.get(nodes[k], 0) + int(found[k])
    return counts, forest


def _refined(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks whose boxes come within eps, by levels of intervals of the sequence."""
    spark, wide = blocks.sparkSession, F.lit(eps * eps * (1 + _SLACK) + _SLACK)
    leaves = blocks.select("leaf", "label", "lo", "hi")
    levels, node = [leaves], leaves
    total = leaves.count()
    dim = F.size("lo")
    while total > FANOUT:
        node = node.withColumn("leaf", F.expr(f"leaf DIV {FANOUT}"))
        low = F.posexplode(F.arrays_zip("lo", "hi"))
        box = node.select("leaf", "label", low.alias("axis", "x")).groupBy("leaf", "axis").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))
        by_axis = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("axis", c))), lambda s: s[c])  # noqa: B023,E731
        node = box.groupBy("leaf").agg(by_axis("lo").alias("lo"), by_axis("hi").alias("hi"), F.min("first").alias("label"), F.max("last").alias("last"))
        node = materialize(node, "level")
        levels.append(node.select("leaf", "label", "last", "lo", "hi"))
        node = node.select("leaf", "label", "lo", "hi")
        total = -(-total // FANOUT)
    pairs = spark.range(total).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence("i", F.lit(total - 1).cast("long"))))
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        level = level if "last" in level.columns else level.withColumn("last", F.col("label"))
        a = level.select(F.col("leaf").alias("i"), *(F.col(c).alias(f"a_{c}") for c in ("label", "last", "lo", "hi")))
        b = level.select(F.col("leaf").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("label", "last", "lo", "hi")))
        gap = F.aggregate(F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi"), F.lit(0.0), lambda acc, s: acc + F.pow(F.greatest(F.lit(0.0), s["a_lo"] - s["b_hi"], s["b_lo"] - s["a_hi"]), F.lit(2.0)))
        near = pairs.join(a, "i").join(b, "j").filter("a_label <= b_last AND b_label <= a_last").filter(gap <= wide).select("i", "j")
        if depth:
            grown = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col(c) * FANOUT + k))  # noqa: B023,E731
            near = near.withColumn("x", grown("i")).withColumn("y", grown("j")).filter("x <= y").select(F.col("x").alias("i"), F.col("y").alias("j"))
        pairs = materialize(near, "pairs")
    return pairs


def _of_one_width(some: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(key, links) and (u, v) over the classes of one dimension."""
    spark, eps = some.sparkSession, float(np.sqrt(2 - 2 * cosine))
    sample = some.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    axes, k = _axes(_unit(sample, dim)), min(AXES, dim)
    cells = _grid(some.select("key", "label", "v", "n"), dim, axes, eps, k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "cells", "key"]
    # By label and cells, and by key inside a cell, so that one full cell does not land in one task.
    dealt = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = materialize(_blocks(dealt, dim, axes, BLOCK), "blocks")
    sizes = sorted((r["part"], r["n"]) for r in packed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    start = np.cumsum([0, *(n for _, n in sizes)])
    first = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, start, strict=False)], "part int, first long")
    blocks = packed.join(F.broadcast(first), "part").withColumn("leaf", F.col("first") + F.col("seq"))
    pairs = _refined(blocks, eps)
    bodies = blocks.select("leaf", "body")
    met = pairs.join(bodies.select(F.col("leaf").alias("i"), F.col("body").alias("left")), "i")
    met = met.join(bodies.select(F.col("leaf").alias("j"), F.col("body").alias("right")), "j").select("i", "j", "left", "right")
    eps2 = eps * eps * (1 + _SLACK) + _SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, left, right in zip(*(b.column(c) for c in range(4)), strict=True):
                counts, forest = _links(left.as_py(), right.as_py(), i == j, dim, cosine, eps2)
                u = [*counts, *(e[0] for e in forest)]
                v = [None] * len(counts) + [e[1] for e in forest]
                n = [*counts.values(), *([None] * len(forest))]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "n"])

    found = materialize(met.mapInArrow(run, "u binary, v binary, n long"), "links")
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("links"))
    return counts, found.filter("v IS NOT NULL").select("u", "v")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    A vector that is null, empty, zero or has a null or non-finite element, or whose label is null,
    links with nothing and is its own component. Vectors of different lengths
    do not link. Repeated rows and equal vectors link with each other. component_id is the smallest non-null id of the
    component; a row with a null id has kept null. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows, some = classes(vectors, id_col, vec_col, label_col)
    counts = edges = None
    for r in sorted(some.select("dim").distinct().collect()):
        c, e = _of_one_width(some.filter(F.col("dim") == r["dim"]), r["dim"], cosine)
        counts, edges = (c, e) if counts is None else (counts.union(c), edges.union(e))
    if counts is None:
        named = some.select("key", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("lowest"))
    else:
        roots = components(edges, "u", "v")
        rooted = some.join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
        rooted = materialize(rooted, "rooted")
        named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("lowest")), "root").select("key", "n_links", "lowest")
    linked = rows.filter("key IS NOT NULL").join(named, "key").select("vec_id", "n_links", F.col("lowest").alias("component_id"))
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
