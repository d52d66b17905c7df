"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by fixed patterns. A fourth, wider generator proposes tokens
that look random; on their own they are too many, so the hash of every value is counted over the corpus by
distinct repositories and owners: a value that many carry is a widely copied example, one that
stays with a few owners and repositories looks live, and only such are added as spans of kind ``owned``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Tokens of 20 characters and more that hold a digit, a capital and a small letter, or begin like a provider's.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])|(?=gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|sk-|npm_|pypi-|AIza|ASIA))[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")
#: A value that more owners than this carry is a widely copied example.
MAX_OWNERS = 2
#: So is one in more repositories than this, also if they are of one owner.
MAX_REPOS = 3
#: Distinct characters that a candidate has at least.
LEAST_DISTINCT = 12

_SPAN = "array<struct<start:int,rank:int,stop:int,hash:string>>"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Elements of a block of running sums; code points of a chunk of text.
_BLOCK, _CHUNK = 128, 1024


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: what stands inside a lambda is computed anew for each of its calls."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The running f (associative, of whole numbers of at least 0) of an array, itself included.

    Blocks are run through one by one and then moved by what stands before them, as an array that grows is copied in each step.
    """
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.concat(acc, F.array(f(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x)))
    inner = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(_BLOCK)), lambda i: F.aggregate(F.slice(xs, i + 1, F.lit(_BLOCK)), none, step))
    moved = lambda blocks, sums: F.flatten(F.transform(blocks, lambda b, i: _let(F.coalesce(F.get(sums, i - 1), F.lit(0)), lambda t: F.transform(b, lambda x: f(t, x)))))
    whole = lambda blocks: _let(F.aggregate(blocks, none, lambda acc, b: step(acc, F.element_at(b, -1))), lambda sums: moved(blocks, sums))
    return _let(xs, lambda x: F.when(F.size(x) > 0, _let(inner(x), whole)).otherwise(none))


def _spans(text: Column, pattern: str, rank: int, least: int = 1, group: int = 0, distinct: int = 0) -> Column:
    """The pattern's leftmost non-overlapping matches, in code points, as structs (start, rank, stop, hash of the value).

    Matches and the pieces between them alternate, so positions are running sums of lengths.
    Only matches whose ``group`` has ``least`` characters, and ``distinct`` different ones, are returned. Linear in text and matches.
    """
    lit = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, lit, F.lit(0)).alias("hit"), F.regexp_extract_all(text, lit, F.lit(group)).alias("value"))
    width = lambda z: F.length(z["piece"]) + F.coalesce(F.length(z["hit"]), F.lit(0))
    letters = F.array(*map(F.lit, _LETTERS))

    def found(parts: Column) -> Column:
        ends = _running(F.transform(parts, width), lambda a, b: a + b)
        both = F.zip_with(parts, ends, lambda z, e: F.struct(z["hit"].alias("hit"), z["value"].alias("value"), e.alias("stop")))
        ok = lambda x: x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        rich = lambda x: ok(x) & (F.size(F.filter(letters, lambda c: F.contains(x["value"], c))) >= distinct)
        kept = F.filter(both, rich if distinct else ok)
        return F.transform(kept, lambda x: F.struct((x["stop"] - F.length(x["hit"])).alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.sha2(x["value"], 256).alias("hash")))

    return F.when(text.rlike(pattern), _let(zipped, found)).otherwise(F.array().cast(_SPAN))


def _said(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ",")


def _wider(text: Column, base: Column) -> Column:
    """Spans of wider tokens that no base span overlaps: none begins before and ends inside, or begins inside."""
    big = F.lit(2**31 - 1)

    def apart(spans: Column) -> Column:
        is_base = lambda s: s["rank"] < 3
        before = _running(F.transform(spans, lambda s: F.when(is_base(s), s["stop"]).otherwise(0)), F.greatest)
        # Distances from the end, so that the least is found as the greatest.
        after = F.reverse(_running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), big - s["start"]).otherwise(0))), F.greatest))
        edges = F.arrays_zip(before.alias("before"), after.alias("after"))
        each = F.zip_with(spans, edges, lambda s, e: F.struct(s.alias("s"), (~is_base(s) & (e["before"] <= s["start"]) & (big - e["after"] >= s["stop"])).alias("free")))
        return F.transform(F.filter(each, lambda x: x["free"]), lambda x: x["s"])

    wide = _spans(text, OWNED, 3, distinct=LEAST_DISTINCT)
    return _let(wide, lambda w: F.when(F.size(w) > 0, _let(F.array_sort(F.concat(base, w)), apart)).otherwise(w))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, owner, repo, base, wider, key, then ``keep``): what each text holds, in one pass and without a shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")) if owner_col else F.lit("")
    repo = F.to_json(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols))) if repo_cols else F.lit("")
    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), owner.alias("owner"), repo.alias("repo"), *kept)
    t = F.col("text")
    rows = rows.withColumn("base", F.concat(_spans(t, ASSIGN, 0, 8, 1), _spans(t, ACCESS, 1, 16), _spans(t, HEX, 2)))
    rows = rows.withColumn("wider", _wider(t, F.col("base")))
    return rows.withColumn("key", F.when(F.size("base") + F.size("wider") > 0, F.sha2("text", 256)))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repos, copies) of every candidate value; counts are combined before each shuffle."""
    each = rows.filter("key IS NOT NULL").select("owner", "repo", F.explode(F.concat("base.hash", "wider.hash")).alias("hash"))
    repos = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("copies"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("copies").alias("copies"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("copies").alias("copies"))


def _live(rows: DataFrame, max_owners: int) -> DataFrame:
    """(key, live): the spans of owner-specific values by distinct text."""
    texts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first(F.concat("base", "wider")).alias("all"))
    spans = texts.select("key", F.explode("all").alias("span"))
    few = ownership(rows).filter((F.col("owners") <= max_owners) & (F.col("repos") <= MAX_REPOS)).select("hash")
    return spans.withColumn("hash", F.col("span.hash")).join(few, "hash", "left_semi").groupBy("key").agg(F.collect_list("span").alias("live"))


def with_spans(rows: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Adds to what :func:`found` gives: spans, the base ones and the wider live ones, and live.

    ``rows`` is read several times, so it should be stored.
    """
    none = F.array().cast(_SPAN)
    some = rows.filter("key IS NOT NULL").join(_live(rows, max_owners), "key", "left").withColumn("live", F.coalesce("live", none))
    some = some.withColumn("spans", F.concat("base", F.filter("live", lambda s: s["rank"] == 3)))
    rest = rows.filter("key IS NULL").withColumn("live", none).withColumn("spans", F.col("base"))
    return rest.unionByName(some)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied), one row per input row.

    The counts by kind are of base spans; n_live and n_copied divide all spans by whether their values stay with few owners and repositories. A null text is empty: it has no spans, and base_sha256 of the empty string. Null owners and repositories
    count as one of their own; null ids and repeated rows are kept. Columns other than those named are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = materialize(found(docs, id_col, text_col, owner_col, repo_cols).drop("text"), "found")
    n = lambda col, rank: F.size(F.filter(col, lambda s: s["rank"] == rank)).cast("long")
    return with_spans(rows, max_owners).select(
        "doc_id", *(n("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), n("spans", 3).alias("n_owned"),
        F.size("live").cast("long").alias("n_live"), (F.size("spans") - F.size("live")).cast("long").alias("n_copied"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans replaced; overlapping spans become one mark. Linear in text and spans: it is cut into chunks, as a substring is searched from the beginning."""

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")
        inside = F.substring(F.get(chunks, first), a % _CHUNK + 1, b - a)
        parts = F.array(F.substring(F.get(chunks, first), a % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(F.get(chunks, last), F.lit(1), (b - 1) % _CHUNK + 1))
        return F.when(a >= b, "").when(first == last, inside).otherwise(F.array_join(parts, ""))

    def marked(chunks: Column, spans: Column, ends: Column) -> Column:
        gaps = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("a"), s["start"].alias("b")))
        said = F.transform(F.filter(gaps, lambda g: g["b"] >= g["a"]), lambda g: F.concat(cut(chunks, g["a"], g["b"]), F.lit(mark)))
        return F.concat(F.array_join(said, ""), cut(chunks, F.element_at(ends, -1), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    whole = _let(F.array_sort(spans), lambda s: _let(_running(F.transform(s, lambda x: x["stop"]), F.greatest), lambda e: _let(chunks, lambda c: marked(c, s, e))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced in the text and the length, if there is such a column, counted anew.

    Only texts that hold a span are moved; the others pass through.
    """
    names = docs.columns
    small = materialize(found(docs, id_col, text_col, owner_col, repo_cols).drop("text"), "found")
    live = materialize(_live(small, max_owners), "live")
    rows = found(docs, id_col, text_col, owner_col, repo_cols, tuple(names))
    some = rows.filter("key IS NOT NULL").join(live, "key", "left")
    more = F.filter(F.coalesce("live", F.array().cast(_SPAN)), lambda s: s["rank"] == 3)
    new = redacted(F.col("text"), F.concat("base", more))
    column = lambda i, c, clean: (new if c == text_col else F.length(new).cast(docs.schema[c].dataType) if c == length_col else F.col(f"kept_{i}")) if clean else F.col(f"kept_{i}")
    # Other names at first: inside lambdas a name may also mean what the same select gives out under it.
    parts = [df.select(*(column(i, c, clean).alias(f"out_{i}") for i, c in enumerate(names))) for df, clean in ((rows.filter("key IS NULL"), False), (some, True))]
    return parts[0].unionByName(parts[1]).toDF(*names)
