"""Best-fit packing of tokenized documents by exact-complement hashing.

Packing looks at lengths only, and there are at most ``capacity`` different ones. So the
plan is made from the histogram of lengths: a table of patterns (which lengths share a sequence, how
often), first those that fill a sequence exactly with one, two or three complements
found in sum indexes under the counts that are left, then best-fit decreasing for the rest. Each
step exhausts a length or a group of equal sequences, so the plan has a bound that does not depend on the
number of documents: at most 4 * capacity groups of at most 63 different lengths. The
pieces then find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize
from codeloom.llm.memo import WordMemo

CAPACITY, SEPARATOR = 2048, 0


#: The normalizer and splitter under which segments finer than chunks are exact.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_SPLITTER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_OTHER, _LETTER, _DIGIT, _SYMBOL, _APOSTROPHE, _WHITE = range(6)
_GROUP_BYTES = 1 << 23


def _tables() -> tuple[bytes, bytes, np.ndarray]:
    """The kind of each byte, the same for chunks alone, and whether a segment ends between two kinds (8 * first + second)."""
    kinds, chunks = bytearray(256), bytearray(256)
    for k in range(33, 127):
        kinds[k] = _DIGIT if chr(k).isdigit() else _LETTER if chr(k).isalpha() else _APOSTROPHE if chr(k) == "'" else _SYMBOL
    for k in b" \t\n\v\f\r":
        kinds[k] = chunks[k] = _WHITE
    cut = np.zeros(64, bool)
    for a in range(6):
        for b in range(5):  # white space stays with what it follows
            cut[8 * a + b] = a in (_WHITE, _DIGIT) or b == _DIGIT or (a, b) in ((_LETTER, _SYMBOL), (_LETTER, _APOSTROPHE), (_SYMBOL, _LETTER))
    return bytes(kinds), bytes(chunks), cut


_KINDS, _CHUNKS, _CUT = _tables()


class ChunkCoder(WordMemo):
    """Token ids of texts, by segments that the tokenizer never joins.

    The tokenizer's normalizer and splitter keep nothing across ASCII white space, so the
    ids of a text are those of its chunks in a row. Under the normalizer and splitter above, chunks are cut
    further where every match of the splitter ends, whatever surrounds it, and nothing composes: beside an ASCII digit, after an ASCII letter before
    a symbol, and after a symbol before a letter, but not after an apostrophe, which begins contractions. A-Z are
    lower-cased first, but not where combining marks (U+0300 to U+036F) could compose with one case only. Texts
    that hold a special string, in any case, are cut at white space alone and keep their case.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fine = (file["normalizer"], file["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER)
        self.special = [x["content"].encode().lower() for x in file["added_tokens"]]
        one = ((c, self.tokenizer.encode(c, add_special_tokens=False).ids) for c in "þðŋʃʒəßøœæq")
        self.mark, (self.mark_id, *_) = next(x for x in one if len(x[1]) == 1)
        super().__init__()

    def _shown(self, text: bytes) -> tuple[bytes, bytes]:
        """The text as it is encoded, and the kinds of its bytes."""
        low = text.lower()
        if not self.fine or any(x in low for x in self.special):
            return text, text.translate(_CHUNKS)
        return text if b"\xcc" in text or b"\xcd" in text else low, text.translate(_KINDS)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP_BYTES:
                yield from self._segments(group)
                group, size = [], 0
        if group:
            yield from self._segments(group)

    def _segments(self, group: list[bytes]) -> Iterator[np.ndarray]:
        """Equal segments are found natively, so that each is looked up once."""
        shown = [self._shown(x) for x in group]
        text = b"\n".join(x for x, _ in shown)
        kinds = np.frombuffer(bytes([_WHITE]).join(k for _, k in shown), np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(_CUT[kinds[:-1] << 3 | kinds[1:]]) + 1, [len(text)]])
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(text)]).dictionary_encode()
        ids, done = self._ids(self._places([x.strip() for x in parts.dictionary.to_numpy(zero_copy_only=False).tolist()])[parts.indices.to_numpy()])
        first = np.searchsorted(starts[:-1], np.cumsum([0, *(len(x) + 1 for x in group)]))
        for a, b in pairwise(done[first].tolist()):
            yield ids[a:b]

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Joined by a word of one token that none has, so that one call encodes many."""
        text = [w.decode() for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(text)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) == len(words) - 1:
            return np.delete(ids, cuts), np.concatenate([cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]])
        each = [x.ids for x in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One coder for each worker and file."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: a document's ids and a separator, cut only if longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(texts), strict=True):
                raw = ids.astype("<u4").tobytes() + SEPARATOR.to_bytes(4, "little")
                for k, start in enumerate(range(0, len(ids) + 1, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return pair.mapInArrow(run, _PIECES)


def _exact(left: np.ndarray, capacity: int) -> Iterator[tuple[list[int], int]]:
    """Patterns that fill a sequence exactly, largest length first; takes them from ``left``."""

    def take(pattern: list[int]) -> int:
        lengths, times = np.unique(pattern, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        return n

    for big in range(capacity, 0, -1):
        if not left[big]:
            continue
        gap = capacity - big
        if gap == 0:
            yield [big], take([big])
            continue
        if gap <= capacity and left[gap] and (n := take([big, gap])):
            yield [big, gap], n
        for a in range(gap - 1, (gap - 1) // 2, -1):  # pairs of the gap's sum
            if not left[big]:
                break
            if left[a] and left[gap - a] and (n := take([big, a, gap - a])):
                yield [big, a, gap - a], n
        for c in range(gap - 2, 0, -1):  # triples: c with the pairs of what remains
            if not left[big]:
                break
            if not left[c]:
                continue
            rest = gap - c
            some = left[: rest + 1] > 0
            for a in np.flatnonzero(some[1:rest] & some[1:rest][::-1]) + 1:
                if not (left[big] and left[c]):
                    break
                if a <= rest - a <= c and left[a] and left[rest - a] and (n := take([big, c, int(a), rest - int(a)])):
                    yield [big, c, int(a), rest - int(a)], n


def _best_fit(left: np.ndarray, capacity: int) -> Iterator[tuple[list[int], int]]:
    """Best-fit decreasing over groups of equal sequences."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(pattern: list[int], n: int, gap: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                pattern, m = open_[gap].pop()
                used = min(n, m)
                if not open_[gap]:
                    del open_[gap], gaps[k]
                if m > used:
                    put(pattern, m - used, gap)
                put([*pattern, size], used, gap - size)
                n -= used
                continue
            fit = capacity // size
            if n >= fit:
                put([size] * fit, n // fit, capacity - fit * size)
            if n % fit:
                put([size] * (n % fit), 1, capacity - n % fit * size)
            n = 0
    for groups in open_.values():
        yield from groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, how many in a sequence, first sequence, offset), sorted by length and rank.

    The piece of a length with rank first + i, for i below how many * sequences of the pattern,
    goes to sequence first sequence + i // how many.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    patterns = [*_exact(left, capacity)]
    for pattern, n in [*patterns, *_best_fit(left, capacity)]:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            rows.append((length, taken[length], k, sequence, offset))
            taken[length] += k * n
            offset += k * length
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds rank, from 0 and gapless within each length.

    A length may hold most pieces, so each is dealt to ``buckets`` buckets, ranked there, and
    moved up by the count of the buckets before.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("own", F.row_number().over(within) - 1)
    return rows.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    ``path``: a tokenizer file whose splitter separates at white space. A null or empty text
    is one piece, the separator alone. Null ids and repeated rows are packed like any others. Other columns are
    ignored, whatever their names; an empty table gives an empty result. Only
    the histogram of lengths (at most ``capacity`` rows) comes to the driver.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = plan(histogram, capacity)
    shift = 40  # a rank has fewer bits
    known = spark.sparkContext.broadcast((layout[:, 0] << shift | layout[:, 1], layout))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows_ = known.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = rows_[np.searchsorted(keys, length << shift | rank, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            i = rank - row[:, 1]
            found = [row[:, 3] + i // np.maximum(row[:, 2], 1), row[:, 4] + i % np.maximum(row[:, 2], 1) * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], [*batch.schema.names[:5], "sequence_id", "offset"])

    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(rows, buckets).select(*order).mapInArrow(place, _PIECES + ", sequence_id long, offset long")
