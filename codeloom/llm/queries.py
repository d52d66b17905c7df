"""Queries opN_<name> over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import table
from codeloom.llm.url_filter import THRESHOLD, TWO_LABEL_SUFFIXES, Z


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source; its repositories are told apart by language."""
    from codeloom.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded by Viterbi, over the unigram model of the file's pieces."""
    from codeloom.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), unigram=True)


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome: its label, good where it is of quality and not toxic."""
    from codeloom.llm.url_filter import judge

    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "CAST(quality = 1 AND toxic = 0 AS long) AS good")
    return judge(table(spark, sf_dir, "pages"), outcomes)


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.context_mixing import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.quality_rules import quality

    return quality(table(spark, sf_dir, "documents")).drop("n_lines", "n_letters")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_epsilon_grid_join, op2_pii_boosted, op3_secret_ownership, op4_token_counts, op5_sentencepiece_round_trip, op6_url_reputation, op7_context_mixing, op8_best_fit_packing, op9_simhash_near_dedup, op10_quality_rules)}

_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


def _strength_sql(of: str) -> str:
    rho = """(sum(CASE WHEN n > 0 THEN good::DOUBLE * good / n END) - sum(good)::DOUBLE * sum(good) / sum(n) - sum(good) / sum(n) * (1 - sum(good) / sum(n)) * (count(*) FILTER (n > 0) - 1))
        / nullif(sum(good) / sum(n) * (1 - sum(good) / sum(n)) * (sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) FILTER (n > 0) - 1)), 0)"""
    return f"SELECT (1 - rho) / rho AS s FROM (SELECT least(greatest(coalesce({rho}, 0), 0.001), 0.5) AS rho FROM {of})"


ORACLE: dict[str, str] = {
    "op6_url_reputation": f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE AS good FROM labels GROUP BY 1),
g0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good, regexp_replace(host, '^[^@]*@|:[0-9]*$|[.]+$', '', 'g') AS site FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
h0 AS (SELECT host, n, good, site, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') AS two,
    array_to_string(list_slice(string_split(site, '.'), -3, -1), '.') AS three, string_split(site, '.')[-1] AS one, regexp_matches(site, '^[0-9.]+$|^\\[') AS numeric FROM g0),
h AS (SELECT host, n, good, CASE WHEN numeric THEN site WHEN two IN ({_TWO}) THEN three ELSE two END AS domain, CASE WHEN numeric THEN '' WHEN two IN ({_TWO}) THEN two ELSE one END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
sh AS ({_strength_sql("h")}), sd AS ({_strength_sql("d")}), sx AS ({_strength_sql("x")}),
xr AS (SELECT suffix, (good + sx.s * (SELECT sum(good) / sum(n) FROM x)) / (n + sx.s) AS r FROM x, sx),
dr AS (SELECT domain, suffix, (good + sd.s * xr.r) / (n + sd.s) AS r FROM d JOIN xr USING (suffix), sd),
hr AS (SELECT host, n, (good + sh.s * dr.r) / (n + sh.s) AS r, sh.s FROM h JOIN dr USING (domain, suffix), sh),
bad AS (SELECT host FROM hr WHERE r + {Z} * sqrt(r * (1 - r) / (n + s + 1)) < {THRESHOLD}),
k AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM k""",
}
