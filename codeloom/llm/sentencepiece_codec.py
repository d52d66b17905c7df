"""SentencePiece encoding and decoding in batched numpy.

Words of equal length advance together as one matrix. Every substring's hash probes the
sorted keys of the pieces, which gives a table of scores by place and length. A unigram
model is then solved by Viterbi over end positions, its maxima and backpointers for all
words at once. A model of merges (BPE) is not what Viterbi maximizes: it can be read as a unigram model over
the same pieces (``unigram=True``, scores from their ranks), or kept as it is, where the same
table drives the merges instead: all words merge their best pair in each step. The ids are
those of the library for either model. Hash probes are confirmed by decoding each word; a word that differed is spelled by
looking its pieces up as strings.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.memo import WordMemo

_P = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_WORDS = re.compile(rb" *[^ ]+| +")
#: Elements of a table at once; words longer than LONG merge by a heap, places of a longer word than WINDOW are worked by windows: with equal results.
_CELLS, LONG, WINDOW = 1 << 21, 96, 1 << 15
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def as_unigram(model: bytes) -> bytes:
    """The unigram model over a model's pieces: minus the logarithm of a piece's place, in sixteenths.

    Sums of sixteenths are exact in single precision up to a million, so that a text's parts and the whole
    have the same best path.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = UNIGRAM
    for i, piece in enumerate(proto.pieces):
        if piece.type == NORMAL:
            piece.score = -round(16 * math.log(i + 1)) / 16
    return proto.SerializeToString()


class Codec(WordMemo):
    batch = 1 << 14

    def __init__(self, path: str, unigram: bool = False) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = as_unigram(f.read()) if unigram else f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models of unigrams or merges")
        norm = proto.normalizer_spec
        self.identity = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        pieces = proto.pieces
        usable = [i for i, p in enumerate(pieces) if p.type in (NORMAL, USER, UNUSED)]
        if any(p.type == USER for p in pieces):
            raise ValueError("models with symbols of the user are not supported")
        self.unk = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.fallback = len(self.bytes) == 256 and self.library.encode("\U000f1234")[-1] != self.unk
        strings = [pieces[i].piece.replace("▁", " ") for i in usable]
        self.longest = max(map(len, strings))
        self.split = not any(" " in s.lstrip(" ") for s in strings)
        keys = np.array([self._key(s) for s in strings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.scores = np.array([p.score for p in pieces], np.float32)
        normal = [p.score for p in pieces if p.type == NORMAL]
        self.unk_score = np.float32(min(normal, default=0.0)) - np.float32(10)
        self.single = {s: i for s, i in zip(strings, usable, strict=True) if len(s) == 1}
        self.by_string = dict(zip(strings, usable, strict=True))
        said = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else b"" if p.type == CONTROL else p.piece.replace("▁", " ").encode() for p in pieces]
        self.said, self.said_ends = np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)])
        super().__init__()

    @staticmethod
    def _key(s: str) -> int:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in s:
                h = h * _P + np.uint64(ord(c) + 1)
            return int(h ^ np.uint64(len(s)) * _LENGTH)

    def words(self, text: bytes) -> list[bytes]:
        """Parts that no piece crosses, with their leading spaces; each lacks the first one."""
        if not text:
            return []
        if not self.identity:
            text = self.library.normalize(text.decode()).replace("▁", " ").encode()
            return [b"\0" + w for w in (_WORDS.findall(text) if self.split else [text])] if text else []
        if not self.split:
            return [text]
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ")
        return [w[1:] for w in _WORDS.findall(b" " + text)]

    def _shown(self, word: bytes) -> str:
        """The word as the model sees it, ▁ as a space."""
        return (word[1:] if not self.identity else b" " + word).decode().replace("▁", " ")

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        shown = [self._shown(w) for w in words]
        lengths = np.fromiter(map(len, shown), np.int64, len(shown))
        order = np.argsort(lengths, kind="stable")
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            size = int(lengths[group[0]])
            step = max(1, _CELLS // (size * self.longest))
            for k in range(0, len(group), step):
                for found, n in self._solve([shown[i] for i in group[k : k + step]], size):
                    ids.append(found)
                    counts.append(n)
        flat, n = np.concatenate(ids), np.concatenate(counts)
        place = np.argsort(order, kind="stable")  # from the order of lengths back to that of the words
        first, n = (np.cumsum(n) - n)[place], n[place]
        return flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.uint32), np.cumsum(n)

    def _table(self, chars: np.ndarray) -> np.ndarray:
        """Piece of each substring by [word, start, length - 1], or -1."""
        n, size = chars.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            prefix[:, i + 1] = prefix[:, i] * _P + (chars[:, i].astype(np.uint64) + np.uint64(1))
        out = np.full((n, size, min(self.longest, size)), -1, np.int32)
        power = np.uint64(1)
        for k in range(1, out.shape[2] + 1):
            power = power * _P
            key = (prefix[:, k:] - prefix[:, : size + 1 - k] * power) ^ (np.uint64(k) * _LENGTH)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[:, : size + 1 - k, k - 1] = np.where(self.keys[at] == key, self.of[at], -1)
        return out

    def _solve(self, words: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of words of one length, in a row, and how many each has."""
        if size > (LONG if self.kind == BPE else WINDOW):
            for w in words:
                ids = self._spelled(w, self._heap(w) if self.kind == BPE else self._path(w))
                yield np.array(ids, np.int64), np.array([len(ids)])
            return
        with np.errstate(over="ignore"):
            table = self._table(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size))
        lens = self._viterbi(table) if self.kind == UNIGRAM else self._merges(table)
        starts = lens > 0
        ids = np.take_along_axis(table, np.maximum(lens - 1, 0)[:, :, None], 2)[:, :, 0].astype(np.int64)
        plain = ~(starts & (ids < 0)).any(1)
        # Every piece must say what stands at its place; a hash that met another string would show here.
        if self.text(ids[starts & plain[:, None]]) != "".join(w for w, p in zip(words, plain, strict=True) if p).encode():
            plain &= [self.text(i[s & (i >= 0)]) == w.encode() for i, s, w in zip(ids, starts, words, strict=True)]
        done = 0
        for k in [*np.flatnonzero(~plain).tolist(), len(words)]:
            if k > done:
                yield ids[done:k][starts[done:k]], starts[done:k].sum(1)
            if k < len(words):
                own = self._spelled(words[k], [(int(i), int(lens[k, i])) for i in np.flatnonzero(starts[k])])
                yield np.array(own, np.int64), np.array([len(own)])
            done = k + 1

    def _spelled(self, word: str, spans: list[tuple[int, int]]) -> list[int]:
        """Ids of spans (start, length); a character without a piece becomes its bytes, or unknowns in a row become one."""
        out: list[int] = []
        for start, n in spans:
            s = word[start : start + n]
            if s in self.by_string:
                out.append(self.by_string[s])
            elif self.fallback:
                out += [self.bytes[b] for b in s.replace(" ", "▁").encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _viterbi(self, table: np.ndarray) -> np.ndarray:
        """Length of the piece that begins at each place of the best path, else 0; of equal paths the one whose last piece is longest."""
        n, size, longest = table.shape
        score = np.where(table >= 0, self.scores[np.maximum(table, 0)], np.float32(-np.inf)).astype(np.float32)
        score[:, :, 0] = np.where(table[:, :, 0] >= 0, score[:, :, 0], self.unk_score)
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            k = np.arange(min(longest, end), 0, -1)  # longest first
            reach = best[:, end - k] + score[:, end - k, k - 1]
            at = reach.argmax(1)
            best[:, end], back[:, end] = np.take_along_axis(reach, at[:, None], 1)[:, 0], k[at]
        lens, at, rows = np.zeros((n, size), np.int64), np.full(n, size), np.arange(n)
        while (at > 0).any():
            on = at > 0
            step = back[rows[on], at[on]]
            at[on] -= step
            lens[rows[on], at[on]] = step
        return lens

    def _path(self, word: str) -> list[tuple[int, int]]:
        """Viterbi over one long word, whose table is made a window at a time."""
        chars, size, longest = np.frombuffer(word.encode("utf-32-le"), np.uint32), len(word), self.longest
        back, best = np.zeros(size + 1, np.uint8 if longest < 256 else np.int32), np.full(longest, -np.inf, np.float32)
        best[0] = 0  # of the place k at k % longest
        for lo in range(0, size, WINDOW):
            head = max(0, lo - longest + 1)
            with np.errstate(over="ignore"):
                table = self._table(chars[None, head : lo + WINDOW])[0]
            score = np.where(table >= 0, self.scores[np.maximum(table, 0)], np.float32(-np.inf)).astype(np.float32)
            score[:, 0] = np.where(table[:, 0] >= 0, score[:, 0], self.unk_score)
            for end in range(lo + 1, min(size, lo + WINDOW) + 1):
                k = np.arange(min(longest, end, score.shape[1]), 0, -1)  # longest first
                reach = best[(end - k) % longest] + score[end - k - head, k - 1]
                at = reach.argmax()
                best[end % longest], back[end] = reach[at], k[at]
        out, at = [], size
        while at:
            out.append((at - int(back[at]), int(back[at])))
            at -= int(back[at])
        return out[::-1]

    def _merges(self, table: np.ndarray) -> np.ndarray:
        """The same for merges: in each step every word joins its best pair, the leftmost of equals."""
        n, size, longest = table.shape
        score = np.where(table >= 0, self.scores[np.maximum(table, 0)], np.float32(-np.inf)).astype(np.float32)
        lens = np.zeros((n, size + 1), np.int64)
        lens[:, :size] = 1
        live, place = np.arange(n), np.arange(size)
        while len(live):
            own = lens[live]
            after = np.minimum(place + own[:, :size], size)
            pair = own[:, :size] + np.take_along_axis(own, after, 1)
            ok = (own[:, :size] > 0) & (after < size) & (pair <= longest)
            gain = np.where(ok, np.take_along_axis(score[live], np.clip(pair, 1, longest)[:, :, None] - 1, 2)[:, :, 0], -np.inf)
            at = gain.argmax(1)
            rows = np.arange(len(live))
            more = gain[rows, at] > -np.inf
            live, at, nxt, pair = live[more], at[more], after[rows, at][more], pair[rows, at][more]
            lens[live, at] = pair
            lens[live, nxt] = 0
        return lens[:, :size]

    def _heap(self, word: str) -> list[tuple[int, int]]:
        """Merges of one long word."""
        n = len(word)
        size, before, after = [1] * n, [i - 1 for i in range(n)], [i + 1 for i in range(n)]
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                j = after[i]
                k = self.by_string.get(word[i : j + size[j]]) if size[i] + size[j] <= self.longest else None
                if k is not None:
                    heapq.heappush(queue, (-float(self.scores[k]), i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [(i, s) for i, s in enumerate(size) if s]

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of ids in a row, as pieces say them."""
        ids = np.asarray(ids, np.int64)
        first = self.said_ends[ids]
        n = self.said_ends[ids + 1] - first
        total = int(n.sum())
        return self.said[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)].tobytes() if total else b""

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts first."""
        said = self.text(ids)
        return said[1:] if said[:1] == b" " else said


@lru_cache(maxsize=4)
def codec(path: str, unigram: bool = False) -> Codec:
    """One codec for each worker, file and reading."""
    return Codec(path, unigram)


def _pair(df: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{col}`").cast(kind).alias("x"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row; a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = codec(path, unigram).encode([x or b"" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _pair(docs, id_col, text_col, "binary").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text), one row per input row; null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [codec(path).decode(np.array(x or [], np.int64)).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return _pair(tokens, id_col, ids_col, "array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, round_trip), one row per input row, without moving the ids.

    ids_crc32 is over little-endian unsigned 32-bit ids; round_trip tells whether decoding them gives the text. A null
    text is empty: no ids, round_trip true. Null ids and repeated rows are kept; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, texts = codec(path, unigram), [x or b"" for x in b.column(1).to_pylist()]
            rows = [(len(t), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), code.decode(ids) == t) for t, ids in zip(texts, code.encode(texts), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])

    return _pair(docs, id_col, text_col, "binary").mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean")
