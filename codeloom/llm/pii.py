"""Personal data by candidate gradient boosting.

Four base kinds are found by fixed patterns and always reported. High-recall generators
propose further spans, which may overlap: obfuscated addresses, phones that the base pattern loses (without a plus, or
run together with the number that follows), identity numbers, account numbers and the like. Boosted trees judge each from its format and
its context, and those over a threshold that was calibrated to a precision on held-out
examples are added where they overlap nothing that is reported already.

The trees are fitted on examples made from templates, the same everywhere, and on weakly labelled candidates of a bounded sample
of the corpus: a candidate inside a phone of the base kinds is personal, one inside an address of the network or a card is no further number.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.boosting import Boosted, threshold

BASE = ("email", "ip", "card", "phone")
ADDED = ("obfuscated", "number", "account", "ipv6")
#: Examples from templates that fit and calibrate the trees; precision that added spans must have on those held out.
EXAMPLES, PRECISION = 6000, 0.99
#: Documents (as expected) whose candidates are weakly labelled, and candidates of them at most.
SAMPLE, LABELLED = 4000, 4000

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits leads where its beginning led, so only beginnings are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_GENERATORS = (
    ("obfuscated", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]++)+")),
    ("number", re.compile(r"(?:(?<![\w+])\+[0-9]{1,3}[ .-]?|(?<![\w.+-]))\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}(?!\w)){1,3}(?![\w-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ipv6", re.compile(r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|::(?:[0-9a-fA-F]{1,4}:){1,6}[0-9a-fA-F]{1,4})(?![\w:])")),
)
#: What a text must hold for a generator to be tried at all.
_HINTS = (re.compile(r"[\[({] ?(?:at|AT) ?[\])}]"), re.compile(r"[0-9]\)?[ .-][0-9]"), re.compile(r"[A-Z]{2}[0-9]{2}"), re.compile(r"[0-9a-fA-F]:[0-9a-fA-F]|::[0-9a-fA-F]"))
_CUES = tuple(re.compile(x) for x in (r"\b(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", r"\b(?:e-?mail|mail|contact|write|reach)\b", r"\b(?:ssn|social|passport|licen[cs]e|national|tax)\b", r"\b(?:iban|account|bank|konto|compte|cuenta)\b", r"\b(?:ip|host|server|address|addr)\b", r"\b(?:order|invoice|version|isbn|page|part|ref|model|item|serial|ticket|build|score)\b", r"\b(?:date|born|since|year|until|on|from)\b"))
Span = tuple[int, str, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, from each @ backwards; a scan from every letter would be slow."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
        done = m.end() if m else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass their test."""
    out = [(a, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Proposals of all generators; they may overlap."""
    return [(m.start(), kind, m.end()) for (kind, pattern), hint in zip(_GENERATORS, _HINTS, strict=True) if hint.search(text) for m in pattern.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    near = [1.0 if c.search(before) else 0.5 if c.search(after) else 0.0 for c in _CUES]
    shape = [len(groups), n, *[len(groups[i]) if i < len(groups) else 0 for i in range(4)], len(groups[-1]) if groups else 0]
    kinds = [float(kind == k) for k in ADDED]
    marks = [s.count(c) for c in ".-( :"]
    return [*map(float, shape), *near, *kinds, *map(float, marks), float(len(s)), float(_luhn("".join(groups)) if n else 0), float(_mod97(s) if kind == "account" else 0), float(before.rstrip().endswith((":", "=", "#"))), float(s.startswith("+")), float(s.count("::"))]


def _mod97(s: str) -> bool:
    """The check of an international account number."""
    s = re.sub(r"[^A-Z0-9]", "", s)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def examples(n: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and outcomes of candidates in sentences from templates: personal data, and numbers that only look so."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(*"abcdefghilmnorstuw") for _ in range(int(rng.integers(2, 9))))

    def iban() -> str:
        body = d(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    good = (
        lambda: (pick("call ", "phone: ", "tel ", "my mobile is ", "fax ") + pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(4)} {d(3)} {d(4)}")),
        lambda: (pick("call ", "phone: ", word() + " ", "") + f"+{d(int(rng.integers(1, 4)))} " + pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}") + pick("", " " + d(16), " " + d(8))),
        lambda: (pick("ssn ", "social security number: ", "tax id ", "national number ") + f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (pick("mail ", "contact ", "write to ", "") + f"{word()}{pick(' [at] ', '(at)', ' (at) ', ' [AT] ')}{word()}{pick('.', ' [dot] ', ' (dot) ')}{pick('com', 'org', 'net')}"),
        lambda: (pick("iban ", "account: ", "bank ", "") + iban()),
        lambda: (pick("ip ", "host ", "server address ") + pick(":".join(f"{rng.integers(1, 65536):x}" for _ in range(8)), f"{rng.integers(1, 65536):x}:{rng.integers(1, 65536):x}::{rng.integers(1, 65536):x}")),
    )
    bad = (
        lambda: (pick("order ", "invoice ", "part no. ", "ref ", "isbn ", "version ", "", word() + " ") + pick(f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(2)}.{d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}")),
        lambda: (pick("on ", "date ", "since ", "") + f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"),
        lambda: (pick("scores ", "pages ", "") + f"{d(2)} {d(3)} {d(2)} {d(2)}"),
        lambda: (pick("model ", "serial ", "build ") + f"AB{d(2)} {d(4)} {d(4)} {d(4)}"),
        lambda: (pick("at ", "time ", "ratio ") + f"{rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}"),
    )
    x: list[list[float]] = []
    y: list[float] = []
    while len(x) < n:
        positive = bool(rng.integers(2))
        text = " ".join(word() for _ in range(int(rng.integers(0, 8)))) + " " + pick(*(good if positive else bad))() + pick(" ", ". ", ", ") + " ".join(word() for _ in range(4))
        for span in candidates(text):
            x.append(features(text, span))
            y.append(float(positive))
    return np.array(x[:n]), np.array(y[:n])


def weak_labels(text: str) -> tuple[list[list[float]], list[float]]:
    """Features and outcomes of the candidates of a text that lie inside a base span."""
    base, x, y = base_spans(text), [], []
    for c in candidates(text) if base else ():
        for a, kind, b in base:
            if a <= c[0] and c[2] <= b and kind != "email":
                x.append(features(text, c))
                y.append(float(kind == "phone"))
                break
    return x, y


def _sampled(pair: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weakly labelled candidates of a sample of the texts, chosen by the hash of the text."""
    total = pair.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                x, y = weak_labels(text.as_py() or "")
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], ["x", "y"])

    mine = pair.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLE))) == 0)
    rows = mine.mapInArrow(run, "x array<double>, y double").distinct().orderBy(F.xxhash64("x"), "y").limit(LABELLED).collect()
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])


@lru_cache(maxsize=1)
def _made() -> tuple[np.ndarray, np.ndarray]:
    return examples()


def model(weak_x: np.ndarray | None = None, weak_y: np.ndarray | None = None) -> tuple[Boosted, dict[str, float]]:
    """The trees, and a threshold for each added kind; two thirds of the examples fit, the rest calibrate."""
    x, y = _made()
    if weak_x is not None and len(weak_x):
        x, y = np.concatenate([x, weak_x]), np.concatenate([y, weak_y])
    fit = np.arange(len(y)) % 3 != 0
    trees = Boosted().fit(x[fit], y[fit])
    held, of = trees.predict(x[~fit]), x[~fit][:, 14 : 14 + len(ADDED)]
    return trees, {k: threshold(held[of[:, i] > 0], y[~fit][of[:, i] > 0], PRECISION) for i, k in enumerate(ADDED)}


def added_spans(text: str, base: list[Span], trees: Boosted, cuts: dict[str, float]) -> list[Span]:
    """Candidates over their threshold, best first, that overlap no reported span."""
    proposed = _apart(candidates(text), base)
    if not proposed:
        return []
    p = np.concatenate([trees.predict(np.array([features(text, c) for c in proposed[k : k + 4096]])) for k in range(0, len(proposed), 4096)])
    out: list[Span] = []  # apart from each other, so sorted by start and by end
    for _, c in sorted((-q, c) for q, c in zip(p, proposed, strict=True) if q >= cuts[c[1]]):
        k = bisect_left(out, c)
        if (k == len(out) or out[k][0] >= c[2]) and (k == 0 or out[k - 1][2] <= c[0]):
            out.insert(k, c)
    return out


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those that overlap none of ``taken``."""
    if not taken:
        return spans
    starts = np.array(sorted(t[0] for t in taken))
    ends = np.maximum.accumulate(np.array([t[2] for t in sorted(taken)]))
    before = np.searchsorted(starts, [s[2] for s in spans], side="left") - 1
    return [s for s, k in zip(spans, before, strict=True) if k < 0 or ends[k] <= s[0]]


def _said(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], rank[s[1]], s[2])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per input row.

    The counts by kind are of base spans; spans holds all. Positions are code points, ends exclusive. A null text is
    empty and has no span. Null ids and repeated rows are kept; other columns are
    ignored, whatever their names; an empty table gives an empty result. The plan has no shuffle but that of the
    few labelled candidates. A candidate of equal probability wins by its start.
    """
    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fitted = model(*_sampled(pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = fitted
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, trees, cuts)
                counts = [sum(s[1] == k for s in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said([*base, *more]), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    return pair.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long")
