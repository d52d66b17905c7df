"""URL filter with an empirical-Bayes host reputation, in DataFrame functions only.

Rules decide first. For other pages, labelled outcomes are pooled by host, registered domain and
public suffix; each level's rate of good pages shrinks to the level above through a beta-binomial
prior whose strength is estimated from how much groups of that level differ. A host is blocked
when even the upper bound of its posterior rate stays below the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of two labels under which names are registered, by their last label; all others have one. Data: other tables may be passed.
TWO_LABEL_SUFFIXES = tuple(f"{x}.{last}" for last, first in {
    "uk": "co org ac gov net sch nhs police me ltd plc", "au": "com net org edu gov id asn", "jp": "co ne or ac ad go ed gr lg", "br": "com net org gov edu", "nz": "co net org ac govt",
    "in": "co net org ac gov firm gen", "za": "co org ac gov net web", "cn": "com net org gov edu ac", "mx": "com org gob edu", "tr": "com org gov edu net", "kr": "co or ac go ne re", "tw": "com org edu gov",
    "hk": "com org edu gov", "sg": "com org edu gov", "my": "com org edu gov", "th": "co or ac go in", "id": "co or ac go web", "ph": "com org edu gov", "il": "co org ac gov", "ar": "com org gob edu",
    "co": "com org edu gov", "pe": "com org edu gob", "ua": "com org edu gov", "pl": "com org edu gov", "es": "com org gob edu", "at": "co or ac gv", "hu": "co org", "eg": "com org edu gov", "ng": "com org edu gov", "ke": "co or ac go",
    "io": "github gitlab", "app": "netlify vercel web", "com": "blogspot wordpress herokuapp", "dev": "pages workers",
}.items() for x in first.split())
Z, THRESHOLD = 1.6448536269514722, 0.5
#: Rules in one expression at most; more of them are joined by host.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """kind: allow or block. target: a host, that covers its subdomains, and the start of the path."""

    kind: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.target.partition("/")[1:])


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _ordered(rules: tuple[Rule, ...]) -> list[Rule]:
    """Longest first, then by text; of equal targets a block."""
    return sorted(rules, key=lambda r: (-len(r.target), r.target, r.kind != "block"))


def matched(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rule and kind of the longest rule that fits (host, path), null where none does."""
    order = _ordered(rules)
    if len(order) > INLINE_RULES:
        return _matched_by_join(pages, order)
    found = F.lit(None).cast("struct<rule:string,kind:string>")
    for r in reversed(order):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.target).alias("rule"), F.lit(r.kind).alias("kind"))).otherwise(found)
    return pages.withColumn("_found", found).withColumns({"rule": F.col("_found.rule"), "kind": F.col("_found.kind")}).drop("_found")


def _matched_by_join(pages: DataFrame, order: list[Rule]) -> DataFrame:
    """The same for many rules: distinct (host, path) by their host suffixes, joined with the rules' hosts."""
    known = pages.sparkSession.createDataFrame([(i, r.target, r.kind, r.host, r.path) for i, r in enumerate(order)], "rank int, rule string, kind string, on string, start string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = pages.select("host", "path").distinct()
    hit = keys.select("host", "path", F.explode(ends).alias("on")).join(known, "on").filter(F.col("path").startswith(F.col("start")))
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct("rule", "kind"), "rank").alias("_found"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_found.rule"), "kind": F.col("_found.kind")}).drop("_found")


def site_of(host: Column) -> Column:
    """The host without the name of a user and a port, under which pages of one site may stand."""
    return F.regexp_replace(host, "^[^@]*@|:[0-9]*$|[.]+$", "")


def _numeric(site: Column) -> Column:
    return site.rlike(r"^[0-9.]+$|^\[")


def suffix_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix; that of an address in numbers is empty."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(_numeric(site), "").when(two.isin(*two_labels), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix; an address in numbers is its own."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(_numeric(site), site).when(two.isin(*two_labels), F.substring_index(site, ".", -3)).otherwise(two)


def _strength(groups: DataFrame) -> Column:
    """Of a beta prior for groups (n, good), by moments: (1 - rho) / rho, rho the correlation inside groups."""
    k, n, g = F.count_if(F.col("n") > 0).cast("double"), F.sum("n").cast("double"), F.sum("good").cast("double")
    p = g / n
    spread = F.sum(F.expr("CASE WHEN n > 0 THEN CAST(good AS double) * good / n END")) - g * g / n
    even = n - F.sum(F.col("n").cast("double") * F.col("n")) / n
    rho = F.try_divide(spread - p * (1 - p) * (k - 1), p * (1 - p) * (even - (k - 1)))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.5))
    return (1 - rho) / rho


def reputation(counts: DataFrame) -> DataFrame:
    """(host, rate, upper): posterior mean and upper bound, from counts (host, n, good), one row per host.

    Only three estimated strengths and the overall rate, one row each, come to the driver.
    """
    hosts = counts.select("host", "n", "good", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    (s_host,), (s_domain,) = hosts.agg(_guarded(hosts)).first(), domains.agg(_guarded(domains)).first()
    s_suffix, overall = suffixes.agg(_guarded(suffixes), F.when(F.sum("n") > 0, F.sum("good") / F.sum("n")).otherwise(F.lit(1.0))).first()
    shrunk = lambda up, s: (F.col("good") + F.lit(s) * up) / (F.col("n") + F.lit(s))
    suffixes = suffixes.select("suffix", shrunk(F.lit(float(overall)), s_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), s_domain).alias("domain_rate"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    rate = shrunk(F.col("domain_rate"), s_host)
    upper = F.col("rate") + F.lit(Z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(s_host) + 1))
    return hosts.withColumn("rate", rate).select("host", "rate", upper.alias("upper"))


def _guarded(groups: DataFrame) -> Column:
    """The strength, 1 where no group has a label."""
    return F.when(F.sum("n") > 0, _strength(groups)).otherwise(F.lit(1.0))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    ``outcomes``: (page_id, good), good 0 or 1; nulls are no outcome, repeated ids count each time. A null url, or one without ://, has
    empty host and path and is judged by the reputation of the empty host. Null ids and
    repeated rows are kept, without labels for the null; other columns are ignored, whatever their names. Empty tables give
    an empty result. No labels at all: every host without a rule is allowed.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    labelled = rows.select("page_id", "host").join(labels, "page_id", "left")
    counts = labelled.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    bad = reputation(materialize(counts, "hosts")).filter(F.col("upper") < threshold).select("host", F.lit("block").alias("own"))
    judged = matched(rows, rules).join(bad, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("kind", "own", F.lit("allow")).alias("verdict"))
