"""A bounded memo of the token ids of words, for texts whose ids are those of their words in a row."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np

_GROUP_WORDS, _MEMO = 1 << 17, 600_000


class WordMemo:
    """Ids of texts by their words: each is encoded once and remembered; at a bound the memo forgets what it met least."""

    #: Words that are encoded at once.
    batch = 256

    def __init__(self) -> None:
        self._clear()

    def words(self, text: bytes) -> list[bytes]:
        raise NotImplementedError

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, in a row, and where each one's end."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forgets the chunks met once, and the rarest down to half of the bound."""
        n = len(self.known)
        uses, ids, ends = self.uses[:n], np.array(self.ids, np.uint32), np.array(self.ends, np.int64)
        kept = np.sort(np.argsort(-uses, kind="stable")[: min(_MEMO // 2, int((uses > 1).sum()))])
        words, size = list(self.known), ends[kept + 1] - ends[kept]
        self._clear()
        self.known = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ends.frombytes(np.cumsum(size).astype(np.int64).tobytes())
        self.ids.frombytes(ids[np.repeat(ends[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes())
        self.uses = uses[kept] // 2

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), self.batch):
            part = words[k : k + self.batch]
            ids, ends = self.encoded(part)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.ends.frombytes((ends.astype(np.int64) + self.ends[-1]).tobytes())
            self.ids.frombytes(ids.tobytes())

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit arrays."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append(self.words(text))
            size += len(group[-1])
            if size >= _GROUP_WORDS:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        ids, done = self._ids(self._places([w for x in group for w in x]))
        k = 0
        for x in group:
            yield ids[done[k] : done[k + len(x)]]
            k += len(x)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The memo's number of each word, after learning the new ones; holds until the next call."""
        if len(self.known) > _MEMO:
            self._shrink()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [words[i] for i in new]
            self._learn(list(dict.fromkeys(fresh)))
            at[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return at

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers, in a row, and where each one's begin, with the end of all; counts the uses."""
        seen = np.bincount(at, minlength=len(self.known))
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        ends = np.frombuffer(self.ends, np.int64)
        first = ends[at]
        n = ends[at + 1] - first
        done = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(first - done[:-1], n) + np.arange(done[-1])] if done[-1] else np.zeros(0, np.uint32)
        return ids, done
