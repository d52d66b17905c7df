"""Driver queries of the engine's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import levels, relational, seed, task, walk
from codeloom.plans.stage import Stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąēėęīįōőøūůűčńšž", "aaaaaaceeeeiiiinooooouuuuyyaaaeeeiiooouuucnsz"


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{_MARKED}', '{_PLAIN}')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({_fold(x)}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(source: str, key: str, words: str, terms: list[str]) -> str:
    listed = ", ".join(f"('{w}')" for w in terms)
    return f"""d AS (SELECT {key}, {_tokens(words)} AS w FROM {source}), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d),
q(term) AS (VALUES {listed}), p AS (SELECT {key}, len(w) AS l, unnest(w) AS term FROM d),
h AS (SELECT {key}, term, any_value(l) AS l, count(*) AS f FROM p WHERE term IN (SELECT term FROM q) GROUP BY {key}, term), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT {key}, term, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) AS b FROM h JOIN df USING (term), n)"""


def _terms(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([("task", w, [w]) for w in words], "task_id string, term string, originals array<string>")


_DOC_TERMS = ["thand", "license", "edon", "ouan"]


@query(f"""WITH {_bm25_sql("documents", "doc_id", "text", _DOC_TERMS)}, s AS (SELECT doc_id, list_reduce(list_sort(list(b / (b + 3))), lambda x, y: x + y) AS x FROM b GROUP BY doc_id)
SELECT doc_id, round(x, 6) AS x, round(x / (x + 2), 6) AS seed FROM s ORDER BY round(x, 6) DESC, doc_id LIMIT 50""")
def seed_topk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a task's terms scored by BM25 over the documents, squashed, added and saturated; the best 50."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    scored = seed.bm25(docs, ["path"], _terms(spark, _DOC_TERMS), F.col("text"), stage=Stage(spark))
    total = seed.totals(scored.select("task_id", "path", (F.col("b") / (F.col("b") + 3)).alias("score")))
    rows = total.select(F.col("path").alias("doc_id"), F.round("x", 6).alias("x"), F.round("seed", 6).alias("seed"))
    return rows.orderBy(F.desc("x"), "doc_id").limit(50)


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', _DOC_TERMS)} SELECT doc_id, term, round(b, 6) AS b FROM b")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    return seed.bm25(docs, ["doc_id"], _terms(spark, _DOC_TERMS), F.col("text"), stage=Stage(spark)).select("doc_id", "term", F.round("b", 6).alias("b"))


_PART_TERMS = ["part", "1", "brass", "small"]


@query(f"WITH {_bm25_sql('part', 'p_partkey', "concat_ws(' ', p_name, p_brand, p_type)", _PART_TERMS)} SELECT p_partkey, term, round(b, 6) AS b FROM b")
def bm25_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over three columns of equal weight, as over name, file and kind of a symbol."""
    part = t(spark, sf_dir, "part")
    return seed.bm25(part, ["p_partkey"], _terms(spark, _PART_TERMS), *map(F.col, ("p_name", "p_brand", "p_type"))).select("p_partkey", "term", F.round("b", 6).alias("b"))


@query(r"""WITH s AS (SELECT p_partkey, p_type AS path, unnest(string_split(p_type, ' ')) AS name FROM part), q(term, o) AS (VALUES ('brass', 'BRASS'), ('small', 'Small'))
SELECT p_partkey, path, name, term, CASE WHEN name = o THEN 3.0::DOUBLE ELSE 3.0::DOUBLE * 0.7 END AS score, CASE WHEN name = o THEN 'S1Exact' ELSE 'S1Folded' END AS signal FROM s JOIN q ON lower(name) = term""")
def s1_exact_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a part's type as a symbol of a file of that name."""
    part = t(spark, sf_dir, "part").select(F.struct(F.col("p_type").alias("type"), "p_partkey").alias("path"), F.explode(F.split("p_type", " ")).alias("name"))
    terms = spark.createDataFrame([("task", "brass", ["BRASS"]), ("task", "small", ["Small"])], "task_id string, term string, originals array<string>")
    return seed.exact_names(part, terms).select(F.col("path.p_partkey").alias("p_partkey"), F.col("path.type").alias("path"), "name", "term", "score", "signal")


_EXTS = ["go", "GO", "py", "tsx", "md", "rs", "mjs", "h"]
_DOC_PATH = "concat_ws('/', source, lang, concat('f', doc_id::VARCHAR, '.', " + "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END))"


def _doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return t(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext)))


@query(f"""WITH p AS (SELECT doc_id, {_DOC_PATH} AS path FROM documents)
SELECT doc_id, path, CASE doc_id % 8 WHEN 0 THEN 'go' WHEN 1 THEN 'go' WHEN 2 THEN 'python' WHEN 3 THEN 'tsx' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'javascript' ELSE 'unsupported' END AS language FROM p""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_paths(spark, sf_dir).select("doc_id", "path", paths.language(F.col("path")).alias("language"))


@query(r"""SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS dir, CASE WHEN regexp_replace(url, '/?[^/]*$', '') = '' THEN 'x' ELSE regexp_replace(url, '/?[^/]*$', '') || '/x' END AS joined,
string_split(url, '/')[-1] AS last, regexp_replace(string_split(url, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM pages""")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", paths.dir_of(url).alias("dir"), paths.join_dir(paths.dir_of(url), F.lit("x")).alias("joined"), paths.last_segment(url).alias("last"), paths.stem_of(url).alias("stem"))


@query("""SELECT r_regionkey, base, raw, expected AS resolved FROM region, (VALUES ('a/b', './c', 'a/b/c'), ('a/b', '../c', 'a/c'), ('a', '../../c', NULL), ('', './x/../y', 'y'), ('a/b', '..', 'a'), ('a', '..', ''), ('', '..', NULL)) v(base, raw, expected)""")
def relative_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("a/b", "./c"), ("a/b", "../c"), ("a", "../../c"), ("", "./x/../y"), ("a/b", ".."), ("a", ".."), ("", "..")]
    raws = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.lit(r).alias("raw")) for b, r in pairs)))
    rows = t(spark, sf_dir, "region").select("r_regionkey", raws.alias("p")).select("r_regionkey", "p.*")
    return rows.withColumn("resolved", paths.resolve_relative(F.col("base"), F.col("raw")))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') || CASE page_id % 3 WHEN 0 THEN '/v2' ELSE '' END AS raw FROM pages)
SELECT page_id, raw, CASE WHEN regexp_matches(string_split(raw, '/')[-1], '^v[0-9]+$') THEN string_split(raw, '/')[-2] ELSE string_split(raw, '/')[-1] END AS qualifier, NOT contains(string_split(raw, '/')[1], '.') AS stdlib FROM p""")
def default_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, "/v2").otherwise(""))
    rows = t(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    return rows.select("page_id", "raw", paths.default_qualifier(F.col("raw")).alias("qualifier"), paths.looks_like_stdlib(F.col("raw")).alias("stdlib"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM documents),
c AS (SELECT doc_id, word || 'Handler2HTTPId' AS id FROM w WHERE length(word) > 3),
s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(id, '([\p{Ll}\p{N}])(\p{Lu})', '\1|\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1|\2', 'g'), '|') AS parts FROM c)
SELECT doc_id, count(*) AS identifiers, sum(len(parts))::BIGINT AS pieces, max(list_max(list_transform(parts, lambda x: length(x)))) AS longest FROM s GROUP BY doc_id""")
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each row: its distinct words in a row of lines are split at once."""
    words = F.filter(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+")), lambda x: F.length(x) > 3)
    # A filter by the number of words would make them once more, as it goes below what makes them.
    docs = t(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[\p{L}\p{N}]{4}"))
    ids = docs.select("doc_id", words.alias("words"))
    lines = F.concat(F.array_join("words", "Handler2HTTPId\n"), F.lit("Handler2HTTPId"))
    each = ids.select("doc_id", F.size("words").cast("long").alias("identifiers"), text.split_camel_lines(lines).alias("parts"))
    return each.select("doc_id", "identifiers", F.size("parts").cast("long").alias("pieces"), F.array_max(F.transform("parts", F.length)).cast("long").alias("longest"))


_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))


@query(rf"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}]+')) AS word FROM documents)
SELECT lower(word) AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE length(word) >= 3 AND NOT regexp_matches(word, '^\p{{N}}') AND lower(word) NOT IN ({_STOP}) GROUP BY 1""")
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's words are counted apart before those of all are added up: ``docs`` needs no distinct over documents."""
    words = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("word"))
    kept = words.filter(~text.shape_dropped(F.col("word")) & ~text.is_stopword(F.lower("word")))
    each = kept.groupBy(F.lower("word").alias("term"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(r"""WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM conversations)
SELECT conv_id, turn, list_has_any(w, ['test', 'tests', 'flaky']) AS test_bias, list_has_any(w, ['config', 'deploy', 'migration', 'migrations']) AS config_bias FROM w""")
def modifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", r"[^\p{L}\p{N}]+")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.test_bias(words).alias("test_bias"), text.config_bias(words).alias("config_bias"))


@query("""WITH c AS (SELECT conv_id, turn, replace(text, ' the ', ' "the" ') AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(x, '"([^"]*)"', 1), lambda y: trim(y)), lambda y: y <> ''))), '|') AS spans FROM c""")
def verbatim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.replace(F.col("text"), F.lit(" the "), F.lit(' "the" '))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.verbatim(quoted, '"'), "|").alias("spans"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages), q(term) AS (VALUES ('en'), ('28'), ('example'), ('fr')),
m AS (SELECT page_id, path, lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')) AS stem, list_distinct(string_split(lower(path), '/')) AS segs FROM p),
s2 AS (SELECT page_id, max(CASE WHEN stem = term THEN 1.0::DOUBLE ELSE 0.6 END) * 2.0 AS score FROM m JOIN q ON contains(stem, term) GROUP BY page_id),
s3 AS (SELECT page_id, least(1.0::DOUBLE, count(DISTINCT term) * 0.5) AS score FROM m JOIN q ON list_contains(segs, term) GROUP BY page_id)
SELECT page_id, 'S2' AS signal, score FROM s2 UNION ALL SELECT page_id, 'S3', score FROM s3""")
def stem_and_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    pages = t(spark, sf_dir, "pages").select("page_id", path.alias("name"))
    # Pages may share a path, so the scores of distinct paths are joined back.
    scored = seed.file_names(pages.select(F.col("name").alias("path")).distinct(), _terms(spark, ["en", "28", "example", "fr"]))
    return pages.join(scored, pages["name"] == scored["path"]).select("page_id", "signal", "score")


@query("""SELECT doc_id, CASE WHEN n_chars * 20000 > 52428800 THEN 'too_large' WHEN n_chars * 20000 > 1048576 THEN 'parse_skipped' END AS skip FROM documents""")
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", paths.size_band(F.col("n_chars") * 20000).alias("skip"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(r"""WITH e AS (SELECT ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT AS b, doc_id::VARCHAR AS k, sha256(text) AS m FROM documents),
p AS (SELECT b, sha256(string_agg(k || chr(9) || m, chr(10) ORDER BY k)) AS h FROM e GROUP BY b) SELECT sha256(string_agg(h, '' ORDER BY b)) AS snapshot_id FROM p""")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.snapshot_id(t(spark, sf_dir, "documents"), F.col("doc_id"), F.sha2("text", 256))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


_TREE = "r_name || '/' || n_name || '/' || c_mktsegment"


@query(f"""WITH p AS (SELECT DISTINCT {_TREE} AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT r_name AS d FROM region UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
SELECT path, arg_max(d, length(d)) AS owner FROM p JOIN o ON path = d OR starts_with(path, d || '/') GROUP BY path""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places as directories; regions and half of the nations as modules."""
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path")).distinct()
    owners = n.select(F.col("r_name").alias("dir")).union(n.filter("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name")))
    return relational.longest_prefix(c, "path", owners, "dir")


@query("""WITH p AS (SELECT DISTINCT p_brand AS dir, CASE p_size % 5 WHEN 0 THEN 'main' WHEN 1 THEN lower(p_type) || '_test' ELSE lower(p_type) END AS name FROM part),
b AS (SELECT dir, min({'main': name = 'main', 'name': name}) AS best FROM p WHERE NOT ends_with(name, '_test') GROUP BY dir) SELECT dir, best.name AS name FROM b""")
def importable_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 5 == 0, "main").when(F.col("p_size") % 5 == 1, F.concat(F.lower("p_type"), F.lit("_test"))).otherwise(F.lower("p_type"))
    return relational.importable(t(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), name.alias("name")).distinct())


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return relational.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH s AS (SELECT p_name, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY p_name), l AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN one END AS p_partkey FROM l LEFT JOIN s USING (p_name)""")
def unique_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    return relational.unique_match(lines, part, "p_name", ["l_orderkey", "l_linenumber"], "p_partkey")


@query("""WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), q AS (SELECT p_partkey, p_type || CASE WHEN p_size < 5 THEN '?' ELSE '' END AS p_type FROM part)
SELECT p_partkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) BETWEEN 1 AND 8 THEN 'bound' ELSE 'no_candidate' END AS outcome FROM q LEFT JOIN s USING (p_type)""")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    refs = part.withColumn("p_type", F.concat("p_type", F.when(F.col("p_size") < 5, "?").otherwise("")))
    return relational.capped_candidates(refs, part, "p_type", ["p_partkey"], cap=8)


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_linenumber, p_type FROM r JOIN s USING (l_suppkey, l_partkey) JOIN part ON l_partkey = p_partkey WHERE p_size IN (1, 5, 10, 15, 20, 25, 30)""")
def scoped_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References bind inside a scope (supplier, part) to definitions of some kinds."""
    lines = t(spark, sf_dir, "lineitem")
    scope = lines.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    refs = lines.filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    kinds = t(spark, sf_dir, "part").filter(F.col("p_size").isin(1, 5, 10, 15, 20, 25, 30)).select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return refs.join(scope, ["l_suppkey", "l_partkey"]).join(kinds, "l_partkey").select("l_orderkey", "l_linenumber", "p_type")


@query("""WITH s AS (SELECT user_id, event_id AS start, event_id + 20 + event_id % 40 AS stop, 'span' || event_id AS label FROM events WHERE event_type = 'purchase'),
j AS (SELECT e.user_id, e.event_id, arg_max({'stop': s.stop, 'label': s.label}, s.start) AS last FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.start <= e.event_id GROUP BY ALL)
SELECT user_id, event_id, CASE WHEN last.stop >= event_id THEN last.label END AS container FROM j""")
def containment_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    spans = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("start"), F.expr("event_id + 20 + event_id % 40").alias("stop"), F.concat(F.lit("span"), F.col("event_id").cast("string")).alias("label"))
    return relational.enclosing(events.select("user_id", "event_id"), spans, "user_id", "event_id", "start", "stop", "label")


_PAIRS = "SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src, dst, n, round(0.5 * sqrt(n) / sqrt(n + 8), 9) AS weight FROM ({_PAIRS})")
def edges_ref_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("weight", F.round(text.ref_weight(F.col("n")), 9))


_AFFINITY = "SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND (a.s_suppkey % 3 = 0) <> (b.s_suppkey % 3 = 0)"


@query(_AFFINITY)
def affinity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, nations as directories; every third is a test of the others beside it. Both directions."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 3 == 0).alias("is_test"))
    tests, code = s.filter("is_test").select(F.col("s_suppkey").alias("src"), "s_nationkey"), s.filter("NOT is_test").select(F.col("s_suppkey").alias("dst"), "s_nationkey")
    one = tests.join(code, "s_nationkey").select("src", "dst")
    return one.union(one.select("dst", "src"))


_EDGES = f"""e AS (SELECT 'c' || src AS src, 's' || dst AS dst, 'ref_def' AS kind, 0.5 * sqrt(n) / sqrt(n + 8) AS weight FROM ({_PAIRS})
UNION ALL SELECT 's' || src, 's' || dst, 'test_affinity', 0.7::DOUBLE FROM ({_AFFINITY})
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'import_out', 0.6::DOUBLE FROM lineitem WHERE l_linenumber = 1)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(df: DataFrame, a: str, b: str, kind: str, w: object) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col("src").cast("string")).alias("src"), F.concat(F.lit(b), F.col("dst").cast("string")).alias("dst"), F.lit(kind).alias("kind"), w.alias("weight"))

    imports = t(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    parts = [made(_pairs(spark, sf_dir), "c", "s", "ref_def", text.ref_weight(F.col("n"))), made(affinity_pairs(spark, sf_dir), "s", "s", "test_affinity", F.lit(0.7)), made(imports, "s", "p", "import_out", F.lit(0.6))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_EDGES} SELECT src, dst, kind, round(weight, 9) AS weight FROM e")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("weight", F.round("weight", 9))


_SEEDS = "s AS (SELECT 'c' || c_custkey AS path, c_acctbal / (c_acctbal + 20000) AS seed FROM customer WHERE c_acctbal > 0)"
_WALK = f"""{_EDGES}, tr AS (SELECT src, dst, weight AS w FROM e UNION ALL SELECT dst, src, 0.45 FROM e WHERE kind = 'import_out'), {_SEEDS},
f0 AS (SELECT path, seed AS score FROM s WHERE seed >= 0.05 ORDER BY seed DESC, path LIMIT 64),
h1 AS (SELECT dst AS path, sum(score * w * 0.5) AS prop FROM f0 JOIN tr ON path = src GROUP BY dst),
f1 AS (SELECT path, prop AS score FROM h1 WHERE path NOT IN (SELECT path FROM f0) ORDER BY round(prop, 12) DESC, path LIMIT 64),
h2 AS (SELECT dst AS path, sum(score * w * 0.5) AS prop FROM f1 JOIN tr ON path = src GROUP BY dst),
w AS (SELECT path, coalesce(s.seed, 0) AS seed, coalesce(h1.prop, 0) + coalesce(h2.prop, 0) AS prop FROM s FULL JOIN h1 USING (path) FULL JOIN h2 USING (path)),
tot AS (SELECT path, seed, prop, (seed + 0.8 * prop) / (seed + 0.8 * prop + 2) AS total FROM w)"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.lit("t").alias("task_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.expr("c_acctbal / (c_acctbal + 20000)").alias("seed"))
    return walk.walk(seeds, walk.traversal(_edges(spark, sf_dir)))


@query(f"WITH {_WALK} SELECT path, round(seed, 6) AS seed, round(prop, 6) AS prop, round(total, 6) AS total FROM tot")
def walk_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).select("path", *(F.round(c, 6).alias(c) for c in ("seed", "prop", "total")))


@query(f"""WITH {_WALK}, g AS (SELECT path, CASE WHEN starts_with(path, 'p') THEN 'data' WHEN ends_with(path, '7') THEN 'config' ELSE 'code' END AS role, total + CASE WHEN ends_with(path, '1') THEN 0.1 ELSE 0 END AS total FROM tot),
l AS (SELECT path, role, total, CASE WHEN total >= 0.75 THEN 5 WHEN total >= 0.5 THEN 3 WHEN total >= 0.3 THEN 2 WHEN total >= 0.15 THEN 1 ELSE 0 END AS b FROM g),
c AS (SELECT path, role, total, CASE role WHEN 'config' THEN least(b, 3) WHEN 'data' THEN least(b, 4) ELSE b END AS b FROM l),
k AS (SELECT DISTINCT dst AS path FROM e WHERE kind = 'test_affinity' AND src IN (SELECT path FROM c WHERE b = 5 AND role = 'code'))
SELECT path, round(total, 6) AS total, CASE WHEN path IN (SELECT path FROM k) THEN greatest(b, 4) ELSE b END AS level FROM c""")
def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = _walked(spark, sf_dir).withColumn("role", F.when(path.startswith("p"), "data").when(path.endswith("7"), "config").otherwise("code"))
    named = rows.filter(path.endswith("1")).select("task_id", "path")
    return levels.assign(rows.select("task_id", "path", "total", "role"), _edges(spark, sf_dir), named).select("path", F.round("total", 6).alias("total"), "level")


@query(f"WITH {_EDGES} SELECT dst AS path, count(*) AS degree FROM e WHERE kind = 'import_out' GROUP BY dst")
def map_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.import_degree(_edges(spark, sf_dir))


@query("""SELECT source, doc_id, n_chars, running FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 50000""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's largest documents, as many as a budget of 50,000 characters holds."""
    docs = t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return relational.running(docs, "n_chars", [F.desc("n_chars"), "doc_id"], ["source"]).filter("running <= 50000")


def budget_fit_of(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("source").alias("task_id"), F.col("doc_id").cast("string").alias("path"), "n_chars")
    total = F.col("n_chars") / (F.col("n_chars") + 4000)
    cost = F.map_from_arrays(F.array(*map(F.lit, (0, 1, 2, 3, 4, 5))), F.array(*(F.ceil(F.col("n_chars") * k / 4000).cast("int") for k in (0, 1, 20, 100, 400, 1000))))
    rows = docs.select("task_id", "path", total.alias("total"), levels.band(total).alias("level"), cost.alias("costs"))
    return levels.fit_tasks(rows, 4000)


@query()
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a task over all its documents, fitted into 4,000 tokens."""
    return budget_fit_of(t(spark, sf_dir, "documents"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 13 = 0),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE o_orderstatus END AS h FROM orders)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    old = orders.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 22 <> 0 THEN o_orderstatus END").alias("h"))
    new = orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END").alias("h"))
    new = new.unionByName(orders.filter("o_orderkey % 13 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("h")))
    return relational.classify(old, new, "o_orderkey", "h")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'X' FROM orders WHERE o_orderkey % 17 = 0""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    new = new.unionByName(orders.filter("o_orderkey % 17 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus")))
    return relational.upsert(orders, new, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 29 = 0)")
def gc_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of every 29th number, as most have some order."""
    orders = t(spark, sf_dir, "orders").filter("o_orderkey % 29 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return relational.orphans(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.cascade(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("""SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (1, 2) UNION SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2)""")
def invalidate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages to derive again: those that bind into changed ones, and the changed ones."""
    changed = t(spark, sf_dir, "supplier").filter(F.col("s_nationkey").isin(1, 2)).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(changed, "l_suppkey", "left_semi")
    binders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(lines, "l_orderkey", "left_semi").select("o_custkey")
    return binders.union(t(spark, sf_dir, "customer").filter(F.col("c_nationkey").isin(1, 2)).select("c_custkey")).distinct()


@query("""SELECT 'supplier' AS side, count(*) AS n FROM lineitem WHERE l_suppkey % 9 = 0 UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey % 10 = 0""")
def doctor_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose supplier or part is gone."""
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    suppliers = t(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    parts = t(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    counted = [relational.cascade(lines, known, [c]).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n")) for side, known, c in (("supplier", suppliers, "l_suppkey"), ("part", parts, "l_partkey"))]
    return counted[0].unionByName(counted[1])


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) ORDER BY doc_id LIMIT 10")
def doctor_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample of ten documents without a label, in order."""
    docs = t(spark, sf_dir, "documents").select("doc_id")
    return relational.orphans(docs, t(spark, sf_dir, "labels"), ["doc_id"]).orderBy("doc_id").limit(10)


_CHECK = "(hash IS NULL AND coalesce(skip, '') IN ('too_large', 'unreadable') AND parse_status = 'skipped') OR (hash IS NOT NULL AND (skip IS NULL OR skip = 'parse_skipped'))"
_FILES = """SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'h' END AS hash, CASE doc_id % 6 WHEN 0 THEN 'too_large' WHEN 1 THEN 'parse_skipped' WHEN 2 THEN 'unreadable' END AS skip, CASE doc_id % 4 WHEN 0 THEN 'skipped' ELSE 'ok' END AS parse_status FROM documents"""


@query(f"SELECT doc_id FROM ({_FILES}) WHERE NOT coalesce({_CHECK}, false)")
def doctor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a state that the schema forbids; a null condition counts as one."""
    from codeloom.schemas import FILE_CHECK

    files = t(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 10 < 8 THEN 'h' END AS hash", "CASE doc_id % 6 WHEN 0 THEN 'too_large' WHEN 1 THEN 'parse_skipped' WHEN 2 THEN 'unreadable' END AS skip", "CASE doc_id % 4 WHEN 0 THEN 'skipped' ELSE 'ok' END AS parse_status")
    return files.filter(~F.coalesce(F.expr(FILE_CHECK), F.lit(False))).select("doc_id")


@query("""SELECT count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(DISTINCT l_suppkey) AS suppliers, format('{:.1f}', 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*)) AS rate FROM lineitem""")
def doctor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.countDistinct("l_suppkey").alias("suppliers"))
    return rows.withColumn("rate", F.format_string("%.1f", F.lit(100.0) * F.col("returned") / F.col("lines")))


_REASON = "CASE WHEN quality = 1 AND toxic = 0 THEN 'bound' WHEN toxic = 1 THEN 'ambiguous' ELSE 'no_candidate' END"


@query(f"SELECT coalesce(r, 'no_scope') AS reason, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, {_REASON} AS r FROM labels) l USING (doc_id) GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = t(spark, sf_dir, "labels").select("doc_id", F.expr(_REASON).alias("r"))
    return t(spark, sf_dir, "documents").select("doc_id").join(reasons, "doc_id", "left").groupBy(F.coalesce("r", F.lit("no_scope")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT source, count(*) FILTER (quality = 1) AS r, count(*) FILTER (quality = 0) AS u, count(*) FILTER (quality IS NULL) AS e FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(coalesce(r / nullif(r + e + u, 0), 1.0), 9) AS import_rate, round(coalesce(r / nullif(r + u, 0), 1.0), 9) AS in_repo_rate FROM d""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of resolved to all and to those in the repository; of nothing, 1."""
    from codeloom.plans.derive import rate

    both = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    n = both.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("r"), F.count_if(F.col("quality") == 0).alias("u"), F.count_if(F.col("quality").isNull()).alias("e"))
    return n.select("source", F.round(rate(F.col("r"), F.col("r") + F.col("e") + F.col("u")), 9).alias("import_rate"), F.round(rate(F.col("r"), F.col("r") + F.col("u")), 9).alias("in_repo_rate"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r % 10 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return relational.stride(lines, ["l_orderkey", "l_linenumber"], 10, ["l_suppkey"]).drop("nth")


@query(r"SELECT doc_id, regexp_replace(string_split_regex(text, '\n[ \t]*\n')[1], '[ \t]+(\n|$)', '\1', 'g') AS paragraph FROM documents")
def doc_first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.split("text", r"\n[ \t]*\n"), F.lit(0))
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(first, r"[ \t]+(\n|$)", "$1").alias("paragraph"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def ws_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


@query()
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every conversation turn, by the exact parser."""
    turns = t(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return task.terms_of(task.parse_tasks(turns, "id", "text")).select("task_id", "term", F.array_join("originals", "|").alias("originals"))


_FILES_MADE = "f AS (SELECT count(*) // 10 * 10 AS files FROM documents)"


@query(f"""WITH {_FILES_MADE} SELECT 'import_out' AS kind, (files - 10) * 10 AS n, round((files - 10) * 6.0::DOUBLE, 6) AS weight FROM f WHERE files > 10
UNION ALL SELECT 'ref_def', files - 10, round((files - 10) * 0.5::DOUBLE / 3, 6) FROM f WHERE files > 10""")
def go_synth_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic repository of as many files as there are documents (in tens), parsed, resolved and linked; counts of edges by kind."""
    from codeloom.plans.derive import derive
    from codeloom.plans.stage import Stage
    from codeloom.sources.facts import extract, fact_tables
    from codeloom.sources.synth import synthetic_scan

    files = t(spark, sf_dir, "documents").count() // 10 * 10
    stage = Stage(spark)
    scan = synthetic_scan(spark, files)
    parsed = stage.keep(extract(scan), "parsed")
    edges = derive(fact_tables(scan, parsed))["edges"]
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {_FILES_MADE} SELECT 'func' AS kind, files * 8 + greatest(files - 10, 0) AS n, files * 8 + greatest(files - 10, 0) AS exported FROM f
UNION ALL SELECT unnest(['method', 'struct']), files, files FROM f""")
def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the synthetic repository by kind."""
    from codeloom.sources.facts import extract
    from codeloom.sources.synth import synthetic_scan

    files = t(spark, sf_dir, "documents").count() // 10 * 10
    defs = extract(synthetic_scan(spark, files)).select(F.explode("defs").alias("d"))
    return defs.groupBy(F.col("d.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d.exported")).alias("exported"))
