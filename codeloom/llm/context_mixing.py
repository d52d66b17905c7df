"""Language-model scores by online logistic context mixing.

A text is its words, A-Z lower-cased, and one end. Each token is a path of binary decisions:
frequent words have a Huffman code over the training counts, other words an escape and
then the Huffman codes of their bytes. For every decision three predictors say a probability: the
code's own node, and two tables of hashed contexts, the node with the last symbol and with the
last two (of a spelled byte the last two and four), counted over all training documents. Their log-odds are mixed with
weights chosen by a gate (which of the contexts have been seen often), and the weights are refined online, segment by
segment, inside each text, from a start that was fitted on a share of the training texts, with tables that had not counted
these. The sum of the decisions' logarithms is the probability of the text, and with its bytes gives bits per byte.

Coded words and slots grow with the square root of the training tokens, so that the model can be broadcast.
The base score is a smoothed unigram's, with exact counts of all words: frequent ones are looked up in the
vocabulary, the others are joined with the table of counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

END = b"\n"  # no word holds white space
#: Words with a code of their own, and slots of a table (rounded to a power of two), as multiples of the square root of the training tokens; the largest power, of 2 x 256 MB.
CODED, SLOTS, WIDEST = 64, 256, 26
#: One of so many training documents fits the start weights.
SHARE = 32
#: Symbols between two updates of a text's weights; words, and symbols, in one step of work; words counted before they are passed on.
SEGMENT, WORK, STEP, FLUSH = 48, 1 << 15, 1 << 17, 500_000
RATE, OFTEN, GATES, LEVELS = 1.0, 4, 4, 65
#: Numbers in a block of counts, blocks that are added up by one group.
BLOCK, FAN_IN = 1 << 14, 64
FOLDS, HELD = 7, 2


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = F.col(f"`{id_col}`").cast("long")
    held = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    return docs.select(number.alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman paths of symbols: their lengths, all nodes and all bits in a row; and the log-odds of bit 1 at each node.

    Two queues, of sorted leaves and of joined nodes, whose weights only grow.
    """
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    leaf, total = weights[order].tolist(), []
    up, bit, below = np.zeros(max(1, 2 * n - 1), np.int32), np.zeros(max(1, 2 * n - 1), np.uint8), np.zeros((2, max(0, n - 1)))
    i = j = 0
    for node in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if i < n and (j >= len(total) or leaf[i] <= total[j]):
                pair.append((leaf[i], int(order[i])))
                i += 1
            else:
                pair.append((total[j], n + j))
                j += 1
        (a, x), (b, y) = pair
        up[x] = up[y] = node
        bit[y] = 1
        below[:, node - n] = a, b
        total.append(a + b)
    depth = np.zeros(max(1, 2 * n - 1), np.int32)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    lengths = depth[:n].astype(np.int64)
    nodes, bits = np.zeros(lengths.sum(), np.int32), np.zeros(lengths.sum(), np.uint8)
    at, here = np.cumsum(lengths) - 1, np.arange(n)
    alive = lengths > 0
    while alive.any():
        nodes[at[alive]], bits[at[alive]] = up[here[alive]] - n, bit[here[alive]]
        here[alive] = up[here[alive]]
        at[alive] -= 1
        alive &= here < 2 * n - 2
    return lengths, nodes, bits, np.log((below[1] + 0.4) / (below[0] + 0.4)).astype(np.float32)


@dataclass
class Model:
    """Codes, tables and first weights; its size is bounded by CODED and SLOTS times the root of the training tokens."""

    words: list[bytes]
    logs: np.ndarray  # log10(count + 1) of each word
    start: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    own: np.ndarray
    wide: int = 10  # bits of a slot's number
    tables: np.ndarray | None = None
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.3, 0.5, 0.5], np.float32), (GATES, 1)))

    def __post_init__(self) -> None:
        self.of = {w: i for i, w in enumerate(self.words)}
        self.odds = self.own[self.nodes].astype(np.float32)  # of what comes, by place in the codes
        self.odds[self.bits == 0] *= np.float32(-1)
        if self.tables is None:
            self.tables = np.zeros((2, 1 << self.wide), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("of", "odds") and (k != "tables" or v.any())}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({"tables": None} | state)
        self.__post_init__()

    def stream(self, words: list[bytes], ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their texts: word numbers, and for the unknown an escape and their bytes up to a space."""
        escape = len(self.words)
        rare = np.flatnonzero(ids == escape)
        if not len(rare):
            return ids, owner
        spelled = [words[k] for k in rare]
        takes = np.ones(len(ids), np.int64)
        takes[rare] = np.fromiter(map(len, spelled), np.int64, len(rare)) + 2
        at = np.cumsum(takes) - takes
        out = np.empty(takes.sum(), np.int32)
        letter = np.ones(len(out), bool)
        letter[at] = False
        out[at] = ids
        out[letter] = np.frombuffer(b" ".join(spelled) + b" ", np.uint8).astype(np.int32) + np.int32(escape + 1)
        return out, np.repeat(owner, takes)

    def steps(self, symbols: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(symbols, texts, hashes of both contexts, places in the texts), at most STEP symbols at once.

        The context is of a word the last symbol, and the last two; of a spelled byte the last two, and the last four.
        """
        first = np.searchsorted(owner, np.arange(owner[-1] + 1 if len(owner) else 0)).astype(np.int32)
        for lo in range(0, len(symbols), STEP):
            back, hi = max(0, lo - 4), min(len(symbols), lo + STEP)
            some, whose = symbols[back:hi], owner[back:hi]
            place = np.arange(back, hi, dtype=np.int32) - first[whose]
            past, seen = (some + 2).astype(np.uint32), []
            for k in range(1, 5):
                past = np.concatenate([[1], past[:-1]]).astype(np.uint32)
                past[place < k] = 1
                seen.append(past)
            one = seen[0] * np.uint32(0x9E3779B1)
            two = one ^ (seen[1] * np.uint32(0x85EBCA6B))
            two ^= two >> np.uint32(15)
            letter = np.flatnonzero(some > len(self.words))
            deep = two[letter] * np.uint32(0x2C1B3C6D)
            deep ^= seen[2][letter] * np.uint32(0x297A2D39)
            deep ^= deep >> np.uint32(13)
            deep = deep * np.uint32(0x85EBCA6B) ^ seen[3][letter] * np.uint32(0x9E3779B1)
            one[letter], two[letter] = two[letter], deep ^ (deep >> np.uint32(15))
            k = lo - back
            yield some[k:], whose[k:], one[k:], two[k:], place[k:]

    def decisions(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in the codes and the slots of both contexts of all decisions, and how many each symbol takes."""
        begin = self.start[symbols]
        n = self.start[symbols + 1] - begin
        at = np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        hashed = self.nodes[at].view(np.uint32) * np.uint32(0xC2B2AE35)
        slots = []
        for c in (one, two):
            h = np.repeat(c, n)
            h ^= hashed
            h *= np.uint32(0x27D4EB2F)
            h >>= np.uint32(32 - self.wide)
            slots.append(h.view(np.int32))
        return at, slots[0], slots[1], n

    def slots(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """For each table, slot and bit of all decisions in one number."""
        at, *slots, _ = self.decisions(symbols, one, two)
        bit = self.bits[at]
        for slot in slots:
            slot <<= 1
            slot |= bit
        return slots

    def inputs(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Log-odds of what came, by predictor and decision; the decisions' gates; and how many decisions each symbol takes."""
        at, one, two, n = self.decisions(symbols, one, two)
        one, two, sign = self.tables[0][one], self.tables[1][two], self.bits[at] * np.float32(2) - np.float32(1)
        gate = (one.view(np.uint32) & np.uint32(1)).astype(np.int64)
        gate += (two.view(np.uint32) & np.uint32(1)) * np.uint32(2)
        one *= sign
        two *= sign
        return [self.odds[at], one, two], gate, n

    def score(self, symbols: np.ndarray, owner: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The natural logarithm of each text's probability; ``weights`` [text, gate, predictor] are refined in place.

        In each step the texts' first segments are worked together, then their second ones, and so on.
        """
        w = np.ascontiguousarray(weights.reshape(-1, 3).T)
        out = np.zeros(len(weights))
        for some, whose, one, two, place in self.steps(symbols, owner):
            segment = place // SEGMENT
            segment -= segment.min()
            if segment.any():
                order = np.argsort(segment, kind="stable")
                some, whose, one, two, segment = some[order], whose[order], one[order], two[order], segment[order]
            inputs, gate, n = self.inputs(some, one, two)
            gate += np.repeat(whose * np.int64(GATES), n)
            cuts = np.cumsum(np.bincount(segment, n)).astype(np.int64)
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                if a == b:
                    continue
                g, x = gate[a:b], [i[a:b] for i in inputs]
                z = w[0][g] * x[0]
                z += w[1][g] * x[1]
                z += w[2][g] * x[2]
                np.maximum(z, -30, out=z)
                e = np.exp(np.negative(z, out=z), out=z)
                whole = e + 1
                out += np.bincount(g, np.log(whole), w.shape[1]).reshape(-1, GATES).sum(1)
                e /= whole  # 1 - p of what came
                rate = RATE / np.maximum(np.bincount(g, minlength=w.shape[1]), 64)
                for k in range(3):
                    w[k] += (rate * np.bincount(g, e * x[k], w.shape[1])).astype(np.float32)
        weights[:] = w.T.reshape(weights.shape)
        return -out


def learned(counts: np.ndarray) -> np.ndarray:
    """Log-odds of slots from counts [slot, bit]; the last bit of each number says whether the slot was seen often, so that one look-up gives both."""
    n0, n1 = counts[:, 0], counts[:, 1]
    odds = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8).astype(np.float32).view(np.uint32)
    return (odds & np.uint32(0xFFFFFFFE) | (n0 + n1 >= OFTEN)).astype(np.uint32).view(np.float32)


def _model(counts: DataFrame, tokens: int) -> Model:
    """The codes: words from the most frequent class of counts down, as many whole classes as the bound allows."""
    rank = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(((r["rank"], r["k"]) for r in counts.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least, bound = 0, 1 << 30, CODED * math.isqrt(tokens)
    for r, k in sizes:
        if total + k > bound:
            break
        total, least = total + k, r
    frequent = counts.filter(rank >= least).toArrow() if total else None
    known = sorted(zip(frequent["n"].to_pylist(), frequent["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1])) if frequent else []
    known = known if any(w == END for _, w in known) else [*known, (0, END)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(257)  # the last for words
        for batch in batches:
            n = batch["n"].to_numpy()
            data = np.frombuffer(b"".join(batch["word"].to_pylist()), np.uint8)
            lengths = np.diff(np.frombuffer(batch["word"].cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1]) if len(batch) else np.zeros(0, np.int64)
            seen[:256] += np.bincount(data, np.repeat(n, lengths), 256)
            seen[[32, 256]] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257), pa.int32()), pa.array(seen.astype(np.int64))], ["byte", "n"])

    rare = counts.filter(rank < least).mapInArrow(spell, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    spelled = np.zeros(257, np.int64)
    for r in rare.collect():
        spelled[r["byte"]] = r["n"]
    lengths, nodes, bits, own = _codes(np.array([*(max(1, n) for n, _ in known), spelled[256] + 1], np.int64))
    more, letters, last, own_letters = _codes(spelled[:256] + 1)
    start = np.concatenate([[0], np.cumsum(lengths), lengths.sum() + np.cumsum(more)])
    nodes, bits = np.concatenate([nodes, letters + np.int32(len(own))]), np.concatenate([bits, last])
    logs = np.log10(np.array([n + 1.0 for n, _ in known]))
    wide = min(max(10, round(math.log2(SLOTS * math.isqrt(tokens) + 1))), WIDEST)
    return Model([w for _, w in known], logs, start, nodes, bits, np.clip(np.concatenate([own, own_letters]), -8, 8), wide)


def _grouped(model: Model, texts: Iterable[bytes | None]) -> Iterator[tuple[list[int], list[bytes], np.ndarray, np.ndarray]]:
    """Texts that are worked at once: how many tokens each has, their words, and the words' numbers and texts. Only one group's words are held."""
    escape, sizes, words = len(model.words), [], []

    def group() -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
        ids = np.fromiter(map(model.of.get, words, repeat(escape)), np.int64, len(words))
        return sizes, words, ids, np.repeat(np.arange(len(sizes)), sizes)

    for text in texts:
        own = tokens(text)
        sizes.append(len(own))
        words += own
        if len(words) >= WORK:
            yield group()
            sizes, words = [], []
    if sizes:
        yield group()


def _tables(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds [table, slot] as counted over the training rows without the share that fits the weights, and over all.

    ``rows``: (text, fits). Each task adds up its own; blocks of counts are then added up FAN_IN at a time, however many tasks there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind, size_ = "block int, part int, fits int, counts binary", 2 << model.wide
    block = min(BLOCK, size_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, found, one_more = shared.value, [None, None], np.int32(1)

        for batch in batches:
            fit = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for fits in range(2):
                for _, words, ids, owner in _grouped(model, (x.as_py() for x in batch.column(0).filter(pa.array(fit == bool(fits))))):
                    for some, _, one, two, _ in model.steps(*model.stream(words, ids, owner)):
                        if found[fits] is None:
                            found[fits] = np.zeros((2, size_), np.int32)  # of one task: fewer than 2^31
                        for t, slot in enumerate(model.slots(some, one, two)):
                            np.add.at(found[fits][t], slot, one_more)
        for fits in range(2):
            if found[fits] is not None:
                flat = found[fits].reshape(-1, block)
                full = np.flatnonzero(flat.any(1))
                part = TaskContext.get().partitionId()
                made = [pa.array(full, pa.int32()), pa.array(np.full(len(full), part), pa.int32()), pa.array(np.full(len(full), fits), pa.int32()), pa.array([zlib.compress(flat[k].astype("<i4").tobytes(), 1) for k in full], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["block", "part", "fits", "counts"])

    def summed(table: pa.Table) -> np.ndarray:
        total = np.zeros((2, block), "<i8")
        for fits, x in zip(table["fits"].to_pylist(), table["counts"], strict=True):
            x = zlib.decompress(x.as_py())
            total[fits] += np.frombuffer(x, "<i8" if len(x) == 8 * block else "<i4")
        return total

    def add(table: pa.Table) -> pa.Table:
        total, first = summed(table), [table["block"][0].as_py()] * 2
        counts = [zlib.compress(x.tobytes(), 1) for x in total]
        return pa.table({"block": pa.array(first, pa.int32()), "part": pa.array([table["part"][0].as_py() // FAN_IN] * 2, pa.int32()), "fits": pa.array([0, 1], pa.int32()), "counts": pa.array(counts, pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        total = summed(table)
        odds = [zlib.compress(learned(x.reshape(-1, 2)).tobytes(), 1) for x in (total[0], total.sum(0))]
        return pa.table({"block": table["block"][:1], "without": pa.array(odds[:1], pa.binary()), "whole": pa.array(odds[1:], pa.binary())})

    sums, parts = rows.select("text", "fits").mapInArrow(run, kind), rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        sums, parts = sums.groupBy("block", F.expr(f"part DIV {FAN_IN}")).applyInArrow(lambda _, table: add(table), kind), -(-parts // FAN_IN)
    out = np.tile(learned(np.zeros((1, 2), np.int64)), (2, size_ // 2))
    out = [out.reshape(-1, block // 2), out.copy().reshape(-1, block // 2)]
    odds = materialize(sums.groupBy("block").applyInArrow(finish, "block int, without binary, whole binary"), "odds")
    for r in odds.toLocalIterator():  # as many blocks as the model has
        for x, c in zip(out, ("without", "whole"), strict=True):
            x[r["block"]] = np.frombuffer(zlib.decompress(r[c]), np.float32)
    return out[0].reshape(2, -1), out[1].reshape(2, -1)


def start_weights(texts: DataFrame, shared) -> np.ndarray:
    """Start weights [gate, predictor] of least loss over all decisions of the texts (column text), which the tables have not counted.

    What comes to the driver are numbers of decisions by gate and log-odds, in steps of a quarter: as many cells
    at most for any input. A gate without decisions keeps its weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = shared.value, np.zeros(LEVELS**3 * GATES, np.int64)
        for batch in batches:
            for _, words, ids, owner in _grouped(model, (x.as_py() for x in batch.column(0))):
                for some, _, one, two, _ in model.steps(*model.stream(words, ids, owner)):
                    x, cell, _ = model.inputs(some, one, two)
                    for k in range(3):
                        cell += np.rint((x[k] + 8) * ((LEVELS - 1) / 16)).astype(np.int64) * (GATES * LEVELS**k)
                    found += np.bincount(cell, minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], ["cell", "n"])

    sums = texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, many = sums["cell"].to_numpy().astype(np.int64), sums["n"].to_numpy().astype(np.float64)
    odds = np.stack([cell // (GATES * LEVELS**k) % LEVELS * (16 / (LEVELS - 1)) - 8 for k in range(3)], axis=1)
    weights = shared.value.weights.astype(np.float64)
    for gate in range(GATES):
        x, n = odds[cell % GATES == gate], many[cell % GATES == gate]
        loss = lambda w: float(n @ np.logaddexp(0, -x @ w)) + 0.5 * float(((w - weights[gate]) ** 2).sum())  # noqa: B023, E731
        w = weights[gate].copy()
        for _ in range(50 if len(n) else 0):
            miss = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
            down = np.linalg.solve((x * (n * miss * (1 - miss))[:, None]).T @ x + np.eye(3), x.T @ (n * miss) - (w - weights[gate]))
            size = next((2.0**-k for k in range(12) if loss(w + down * 2.0**-k) < loss(w)), 0)
            w += size * down
            if not size or np.abs(down).max() < 1e-6:
                break
        weights[gate] = w
    return weights.astype(np.float32)


def fitted(rows: DataFrame, counts: DataFrame, total: int) -> Model:
    """The model of training rows (doc_id, text) and their counts."""
    context = rows.sparkSession.sparkContext
    model = _model(counts, total)
    rows = rows.select("text", (F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0).alias("fits"))
    model.tables, whole = _tables(rows, model)
    shared = context.broadcast(model)
    weights = start_weights(rows.filter("fits"), shared)
    shared.destroy()
    model.tables, model.weights = whole, weights
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per input row.

    Documents with crc32(doc_id as text) mod 7 = 2 are held out; the others train. A null or empty text is its
    end alone. A null id counts as empty text for the fold, and trains. Repeated rows are kept, and train each time; other
    columns are ignored, whatever their names. An empty table gives an empty result; with no training document all words are unknown.
    A long text is worked in steps, a long word is spelled like any other, so that memory is bounded by a text's symbols.
    """
    rows = _rows(docs, id_col, text_col)
    training = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(training), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = fitted(training, counts, total)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = model.logs > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        escape = len(model.words)
        for batch in batches:
            out, score, done, rest, many = [], np.zeros(len(batch)), 0, [], [np.zeros(1, np.int64)]
            for sizes, words, ids, owner in _grouped(model, (x.as_py() for x in batch.column(2))):
                n = len(sizes)
                score[done : done + n] = model.score(*model.stream(words, ids, owner), np.tile(model.weights, (n, 1, 1)))
                known = ids < escape
                sums = [np.bincount(owner[known], x[ids[known]], n) for x in (seen, model.logs)]
                rare = np.flatnonzero(~known)
                rest += [words[k] for k in rare.tolist()]
                many.append(np.bincount(owner[rare], minlength=n))
                n_bytes = np.bincount(owner, np.fromiter(map(len, words), np.int64, len(words)), n).astype(np.int64)
                for k in range(n):
                    digest = xxhash.xxh64_intdigest(batch.column(2)[done + k].as_py() or b"") - (1 << 63)
                    out.append((digest, sizes[k], int(sums[0][k]), float(sums[1][k]), int(n_bytes[k]) + sizes[k] - 1))
                done += n
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            made.append(pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(many)), pa.int32()), pa.array(rest, pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array(score)], ["doc_id", "held_out", "hash", "n_tokens", "known", "logs", "n_bytes", "rest", "score"])

    kind = "doc_id long, held_out boolean, hash long, n_tokens long, known long, logs double, n_bytes long, rest array<binary>, score double"
    scored = materialize(rows.mapInArrow(run, kind), "scored")
    met = scored.select("doc_id", "hash", F.explode("rest").alias("word")).join(counts, "word", "left")
    sums = met.groupBy("doc_id", "hash").agg(
        F.sum(F.coalesce(F.log10(F.col("n") + 1), F.lit(0.0))).alias("more_logs"),
        F.count("n").alias("more_known"),
        F.count(F.lit(1)).alias("all_rare"),
    )
    # Repeated rows share a sum; each takes its part.
    own = scored.withColumn("mine", F.size("rest")).drop("rest")
    a, b = own.alias("a"), sums.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash")), "left")
    share = F.coalesce(F.col("mine") / F.col("all_rare"), F.lit(0.0))
    unseen = float(np.log10(total + kinds + 1.0))
    return joined.select(
        "a.doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce(F.round(F.col("more_known") * share), F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("more_logs") * share, F.lit(0.0)) - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        (F.col("score") / float(np.log(10))).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
