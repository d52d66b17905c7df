"""Token counts by overlap resynchronisation.

A huge document is encoded in chunks that overlap, with the offsets of their tokens, and
two neighbours are spliced at a boundary that both have inside the overlap and that is proven
stable: before a space that follows another character, when no piece of the vocabulary holds a
space after another character, so that no merge ever crosses it. If the overlap has none, it is
widened, up to the whole chunk; then the chunk grows instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 15, 256
MARK = "▁".encode()
_GROUP = 1 << 20


class Counter:
    """Counts a text's tokens as the library encodes the whole text."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Without this proof, and without a normalizer that keeps every character, only whole texts are encoded.
        self.stable = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize("a  b\nÅﬁ ") == "▁a▁▁b\nÅﬁ▁"

    def _offsets(self, text: bytes, start: int, end: int) -> list[int]:
        """Where the tokens of text[start:end] begin, in bytes of the text."""
        return [start + p.begin for p in self.model.encode(text[start:end], return_type="proto").pieces]

    def _splice(self, text: bytes, left: list[int], right: list[int], start: int, end: int) -> int:
        """The last stable boundary that both have between start and end, or -1."""
        both = set(right)
        for at in reversed(left):
            if at <= start:
                break
            if at < end and at in both and text[at] == 32 and text[at - 1] != 32 and text[at - 3 : at] != MARK:
                return at
        return -1

    def long(self, text: bytes) -> int:
        """Tokens of a text that is encoded in overlapping chunks."""

        def whole(at: int) -> int:
            """The next place at which a character begins."""
            while at < len(text) and text[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(text))

        total, floor, start, size = 0, 0, 0, self.chunk
        while True:
            end = whole(start + size)
            left = self._offsets(text, start, end)
            if end == len(text):
                return total + sum(x >= floor for x in left)
            overlap, found = self.overlap, -1
            while found < 0 and overlap < end - max(start, floor):
                ahead = whole(end - overlap)
                found = self._splice(text, left, self._offsets(text, ahead, whole(end + overlap)), max(ahead, floor), end)
                overlap *= 2
            if found < 0:  # no common boundary in all of the chunk
                size *= 2
                continue
            total += sum(floor <= x < found for x in left)
            # The next chunk begins a token before the splice, so that the boundary lies inside it too.
            floor, size = found, self.chunk
            start = max(x for x in left if x < found)

    def counts(self, texts: list[str]) -> list[int]:
        out, group, size = [0] * len(texts), [], 0

        def flush() -> None:
            for i, ids in zip(group, self.model.encode([texts[i] for i in group], num_threads=1), strict=True):
                out[i] = len(ids)

        for i, text in enumerate(texts):
            if len(text) > self.chunk and self.stable:
                out[i] = self.long(text.encode())
                continue
            group.append(i)
            size += len(text)
            if size >= _GROUP:
                flush()
                group, size = [], 0
        flush()
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``path``: a sentencepiece model. A null or empty text has 0 bytes and 0 tokens. Null ids
    and repeated rows are kept; other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
