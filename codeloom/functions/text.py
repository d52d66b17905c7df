"""Text scalars of the task parser and the ranking, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about code, by their length.
STOPWORDS = frozenset(
    "a an as at be by do if in is it me my no of on or so to up us we all and any are bug but can did few fix for get got had has her him his how its may new nor not "
    "off our over own she the too use was who why you also auth been both code does done down each even file from func gets have help here hers impl into item just like "
    "make more most much must once only plus repo same some such test than that them they this type upon used uses very were what when will with your about above added "
    "again being below class could doing files fixed fixes flaky issue makes might other ours their there these those types tests under until using where which while "
    "whom would yours adding adds always after because before between bugfix change config deploy during having import method please should struct theirs within "
    "changes classes cleanup fixing further handler itself methods package changing function refactor without implement functions migration implements repository migrations refactoring add".split()
)
TEST_WORDS, CONFIG_WORDS = ("flaky", "test", "tests"), ("config", "deploy", "migration", "migrations")
MIN_TERM = 3
#: Every boundary stands before a capital, so all other places fail at their first look.
CAMEL = r"(?=\p{Lu})(?:(?<=[\p{Ll}\p{N}])|(?<=\p{Lu})(?=\p{Lu}\p{Ll}))"
TOKEN = r"[\p{L}\p{N}]++"
_PLAIN, _MARKED = "aaaaaaceeeeiiiinooooouuuuyyaaaeeeiiooouuucnsz", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąēėęīįōőøūůűčńšž"


def normalize_ws(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def split_camel(s: Column) -> Column:
    """Parts of an identifier: before a capital after a small letter or digit, and before the last capital of a run."""
    return F.split(s, CAMEL)


def split_camel_lines(s: Column) -> Column:
    """Parts of all identifiers, one on each line, in one pass: no boundary depends on what stands beyond a line's end."""
    return F.split(s, rf"{CAMEL}|\n")


def trim_edges(s: Column) -> Column:
    return F.regexp_replace(s, r"^[^\p{L}\p{N}/]+|[^\p{L}\p{N}/]+$", "")


def strip_line_suffix(s: Column) -> Column:
    return F.regexp_replace(s, ":[0-9]+$", "")


def has_source_extension(s: Column) -> Column:
    return F.lower(s).rlike(r"\.(cs|go|java|js|py|rs|ts|tsx)$")


def qualified_parts(s: Column) -> Column:
    """Parts around dots and colons when there are two or more, each of two characters or more and led by a letter; else null."""
    parts = F.filter(F.split(s, "[.:]"), lambda p: p != "")
    good = (F.size(parts) >= 2) & F.forall(parts, lambda p: (F.length(p) >= 2) & p.rlike(r"^\p{L}"))
    return F.when(good, parts)


def shape_dropped(s: Column) -> Column:
    """Empty, led by a digit, or shorter than a term may be."""
    return (s == "") | s.rlike(r"^\p{N}") | (F.length(s) < MIN_TERM)


def is_stopword(lower: Column) -> Column:
    return lower.isin(*sorted(STOPWORDS))


def test_bias(words: Column) -> Column:
    return F.exists(words, lambda w: F.lower(w).isin(*TEST_WORDS))


def config_bias(words: Column) -> Column:
    return F.exists(words, lambda w: F.lower(w).isin(*CONFIG_WORDS))


def verbatim(s: Column, mark: str) -> Column:
    """Trimmed non-empty contents of closed spans between two marks (a back quote or a double quote), sorted and distinct."""
    found = F.regexp_extract_all(s, F.lit(f"{mark}([^{mark}]*){mark}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.trim), lambda x: x != "")))


def fold(s: Column) -> Column:
    """Lower case without the common Latin diacritics."""
    return F.translate(F.lower(s), _MARKED, _PLAIN)


def fts_tokens(s: Column) -> Column:
    """Runs of letters and digits, folded; an underscore separates, capitals do not."""
    return F.filter(F.split(fold(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(s: Column) -> Column:
    """How many tokens :func:`fts_tokens` gives: folding turns letters into letters, so it can be left out."""
    return F.regexp_count(F.lower(s), F.lit(TOKEN))


def folded_regex(tokens: Column) -> Column:
    """A regular expression that finds in a lower-case text whether one of the folded tokens stands there as a whole, with or without diacritics."""
    out = F.array_join(tokens, "|")
    for p in sorted(set(_PLAIN)):
        out = F.replace(out, F.lit(p), F.lit("[" + p + "".join(m for m, q in zip(_MARKED, _PLAIN, strict=True) if q == p) + "]"))
    return F.when(F.size(tokens) == 0, r"(?!)").otherwise(F.concat(F.lit(r"(?:^|[^\p{L}\p{N}])(?:"), out, F.lit(r")(?:$|[^\p{L}\p{N}])")))


def saturate(x: Column, kappa: float = 2.0) -> Column:
    return x / (x + kappa)


def bm25_term(n: Column, df: Column, f: Column, length: Column, avg: Column) -> Column:
    """One term's share: k1 1.2, b 0.75; an idf of 0 or less counts as 1e-6."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg))


def recency(days: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(1 + F.lit(90.0) / F.greatest(days, F.lit(1e-9))) / 6)


def density(hits: Column, divisor: float) -> Column:
    return F.least(F.lit(1.0), hits / divisor)


def ref_weight(n: Column) -> Column:
    """Weight of n references from one file to another."""
    return F.lit(0.5) * F.sqrt(n) / F.sqrt(n + 8)
