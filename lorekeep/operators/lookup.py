"""Lookups and small joins around search: expansion, resolution, versions, sitemaps, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.plans.registry import query
from lorekeep.sources.tables import FILES_SQL, LINES_SQL, files, lines, table

#: Our own glossary: groups of words that stand for each other.
GLOSSARY = [["remove", "delete", "drop"], ["error", "failure", "fault"], ["fetch", "load", "read"], ["user", "account", "member"]]
GENERAL, PROFILE = 0.55, 0.85


def _sql_rows(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) AS t({names}))"


_TERMS = [("q1", "delete"), ("q1", "account"), ("q2", "error"), ("q2", "parser"), ("q3", "deleting")]
_GLOSS = [(i, w) for i, g in enumerate(GLOSSARY) for w in g]


@query(
    f"""WITH t AS {_sql_rows(_TERMS, 'q, term')}, g AS {_sql_rows(_GLOSS, 'grp, word')}, x AS (SELECT q, term AS origin, term, 1.0 AS w FROM t UNION ALL SELECT q, t.term, b.word, {GENERAL} FROM t JOIN g a ON a.word = t.term JOIN g b ON a.grp = b.grp AND b.word <> t.term)
    SELECT q, {tx.stem_sql('term')} AS stem, CAST(max(w) AS DOUBLE) AS weight FROM x GROUP BY ALL"""
)
def expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-EXPAND: words of a term's glossary groups at 0.55, the largest weight by stem."""
    t, g = spark.createDataFrame(_TERMS, "q string, term string"), spark.createDataFrame(_GLOSS, "grp int, word string")
    own = t.select("q", "term", F.lit(1.0).alias("w"))
    same = t.join(g, t["term"] == g["word"]).select("q", F.col("term").alias("origin"), "grp").join(g, "grp").where("word <> origin").select("q", F.col("word").alias("term"), F.lit(GENERAL).alias("w"))
    return own.unionByName(same).groupBy("q", tx.stem(F.col("term")).alias("stem")).agg(F.max("w").alias("weight"))


PHRASES = [("sign in", "login"), ("log in", "login"), ("set up", "configure"), ("look up", "find")]
_PHRASED = ["how do I sign in", "Set up the index", "look up a user and log in", "assign input"]


@query("WITH q AS (SELECT unnest(['" + "','".join(_PHRASED) + "']) AS q) SELECT q, " + "".join("regexp_replace(" for _ in PHRASES) + "lower(q)" + "".join(rf", '\b{a}\b', '{b}', 'g')" for a, b in PHRASES) + " AS replaced FROM q")
def phrase_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-LOCUTION: whole-word phrases become words, in order."""
    out = F.lower("q")
    for a, b in PHRASES:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return spark.createDataFrame([(x,) for x in _PHRASED], "q string").select("q", out.alias("replaced"))


@query(
    r"""WITH q AS (SELECT unnest(['files without tests', 'sans cache mais rapide', 'search without']) AS q), t AS (SELECT q, string_split(lower(q), ' ') AS w FROM q)
    SELECT q, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(['without', 'sans'], w[i]) AND NOT (i > 1 AND list_contains(['without', 'sans'], w[i - 1]))], ' ') AS kept FROM t"""
)
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-QTERMS: a negation drops the word behind it."""
    w = F.split(F.lower("q"), " ")
    neg = F.array(F.lit("without"), F.lit("sans"))
    before = F.concat(F.array(F.lit("")), w)
    kept = F.filter(F.arrays_zip(w.alias("w"), F.slice(before, 1, F.size(w)).alias("b")), lambda x: ~F.array_contains(neg, x["w"]) & ~F.array_contains(neg, x["b"]))
    return spark.createDataFrame([("files without tests",), ("sans cache mais rapide",), ("search without",)], "q string").select("q", F.array_join(F.transform(kept, lambda x: x["w"]), " ").alias("kept"))


@query(
    rf"""WITH {FILES_SQL} SELECT file_id, CAST((length(lower(text)) - length(replace(lower(text), 'thing', ''))) / 5 + (length(lower(text)) - length(replace(lower(text), 'stion', ''))) / 5 AS BIGINT) AS hits FROM files
    WHERE contains(lower(text), 'thing') OR contains(lower(text), 'stion') ORDER BY hits DESC, file_id LIMIT 15"""
)
def docs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-DOCS and GR-DOCSMENTION: sum of raw occurrences, best 15."""
    low = F.lower("text")
    count = lambda w: (F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    hits = (count("thing") + count("stion")).cast("bigint")
    return files(spark, sf_dir).where(F.contains(low, F.lit("thing")) | F.contains(low, F.lit("stion"))).select("file_id", hits.alias("hits")).orderBy(F.desc("hits"), "file_id").limit(15)


@query(
    rf"""WITH {FILES_SQL}, {LINES_SQL}, s AS (SELECT file_id, line_no, substring(line, greatest(1, strpos(lower(line), 'thing') - 80), 200) AS snippet FROM lines WHERE contains(lower(line), 'thing'))
    SELECT file_id, arg_min(snippet, line_no) AS snippet FROM s GROUP BY file_id"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-SNIPPET: about 200 characters around a file's first hit."""
    hit = lines(files(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("thing")))).where(F.contains(F.lower("line"), F.lit("thing")))
    s = hit.select("file_id", "line_no", F.substring(F.col("line"), F.greatest(F.lit(1), F.instr(F.lower("line"), "thing") - 80), F.lit(200)).alias("snippet"))
    return s.groupBy("file_id").agg(F.min_by("snippet", "line_no").alias("snippet"))


_PATHS = ["src/user.ts", "src/user.test.ts", "tests/test_tool.py", "lib/tool.py", "lib/tool_test.go", "lib/other.py"]


@query(
    rf"""WITH p AS {_sql_rows([(x,) for x in _PATHS], 'path')}, k AS (SELECT path, regexp_matches(path, '{tx.TEST_PATH}') AS is_test, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[a-z]+$', ''), '^test_|_test$|\.test$', '') AS stem FROM p)
    SELECT a.path AS file, b.path AS test FROM k a JOIN k b ON a.stem = b.stem AND b.is_test AND NOT a.is_test"""
)
def tests_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-TESTNAME and TXT-ISTEST: tests whose stem is a file's."""
    p = spark.createDataFrame([(x,) for x in _PATHS], "path string")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[a-z]+$", ""), r"^test_|_test$|\.test$", "")
    k = p.select("path", tx.is_test(F.col("path")).alias("t"), stem.alias("stem"))
    return k.where("NOT t").select(F.col("path").alias("file"), "stem").join(k.where("t").select(F.col("path").alias("test"), "stem"), "stem").select("file", "test")


_IMPORTED = [("a.py", "numpy"), ("b.py", "numpy.linalg"), ("c.py", "json"), ("d.ts", "@x/y/z"), ("e.ts", "react")]
_DEPS = [("pypi", "NumPy"), ("npm", "@x/y"), ("npm", "react"), ("pypi", "requests")]


@query(
    rf"""WITH i AS {_sql_rows(_IMPORTED, 'file, spec')}, d AS {_sql_rows(_DEPS, 'eco, name')} SELECT eco, name, file FROM d JOIN i ON regexp_replace(lower(name), '[-_.]+', '-', 'g') = regexp_replace(lower(CASE WHEN starts_with(spec, '@') THEN regexp_extract(spec, '^@[^/]+/[^/]+') ELSE regexp_extract(spec, '^[^/.]+') END), '[-_.]+', '-', 'g')"""
)
def dependency_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-DEPUSAGE and HLP-PKGNORM: files that import a dependency."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    spec = F.when(F.startswith("spec", F.lit("@")), F.regexp_extract("spec", "^@[^/]+/[^/]+", 0)).otherwise(F.regexp_extract("spec", "^[^/.]+", 0))
    i = spark.createDataFrame(_IMPORTED, "file string, spec string").select("file", norm(spec).alias("k"))
    return spark.createDataFrame(_DEPS, "eco string, name string").withColumn("k", norm(F.col("name"))).join(i, "k").select("eco", "name", "file")


_URLS = ["https://d.org/docs/2.1/x", "https://d.org/stable/api", "https://d.org/en/latest/v3/", "https://d.org/guide"]


@query(
    rf"""WITH u AS {_sql_rows([(x,) for x in _URLS], 'url')}, s AS (SELECT url, [x FOR x IN string_split(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/') IF regexp_matches(x, '^v?[0-9]+(\.[0-9]+)*$')] AS strong, [x FOR x IN string_split(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/') IF list_contains(['stable', 'latest', 'main'], x)] AS weak FROM u)
    SELECT url, coalesce(strong[1], weak[1]) AS version, coalesce(starts_with('2.1.4', strong[1] || '.') OR strong[1] = '2.1.4', false) AS matches FROM s"""
)
def url_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-URLVERSION and FLT-VERSION: version of a url, numbers before names; equal or a prefix of 2.1.4."""
    seg = F.split(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "/")
    strong = F.get(F.filter(seg, lambda x: x.rlike(r"^v?[0-9]+(\.[0-9]+)*$")), F.lit(0))
    weak = F.get(F.filter(seg, lambda x: x.isin("stable", "latest", "main")), F.lit(0))
    ok = F.startswith(F.lit("2.1.4"), F.concat(strong, F.lit("."))) | (strong == "2.1.4")
    return spark.createDataFrame([(x,) for x in _URLS], "url string").select("url", F.coalesce(strong, weak).alias("version"), F.coalesce(ok, F.lit(False)).alias("matches"))


SITEMAP = "<urlset><url><loc>https://d.org/a</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://d.org/b</loc></url></urlset>"


@query("SELECT * FROM (VALUES ('https://d.org/a', DATE '2024-01-02'), ('https://d.org/b', NULL)) AS t(loc, lastmod)")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WEB-SITEMAP: locations and dates of a sitemap."""
    e = spark.createDataFrame([(SITEMAP,)], "xml string").select(F.explode(F.regexp_extract_all("xml", F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("e"))
    date = F.nullif(F.regexp_extract("e", r"<lastmod>\s*([0-9-]{10})", 1), F.lit(""))
    return e.select(F.regexp_extract("e", r"<loc>\s*(.*?)\s*</loc>", 1).alias("loc"), date.cast("date").alias("lastmod"))


@query(
    rf"""WITH {FILES_SQL}, r AS (SELECT unnest(['src1/en/doc_1.txt', 'en/doc_21.txt', 'doc_3.txt', 'nowhere.txt']) AS target), c AS (SELECT target, file_id FROM r LEFT JOIN files ON path = target OR ends_with(path, '/' || target))
    SELECT target, CASE WHEN count(file_id) = 1 THEN min(file_id) END AS file_id, CASE count(file_id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM c GROUP BY target"""
)
def resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-RESOLVE and SRC-PROBE: a pasted path to the file with that unique suffix.

    Each path explodes to its suffixes, so this is an equi-join.
    """
    r = spark.createDataFrame([(x,) for x in ("src1/en/doc_1.txt", "en/doc_21.txt", "doc_3.txt", "nowhere.txt")], "target string")
    suffix = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), i, size(split(path, '/'))), '/'))")
    hit = r.join(files(spark, sf_dir).select("file_id", F.explode(suffix).alias("target")), "target", "left")
    return hit.groupBy("target").agg(F.count("file_id").alias("n"), F.min("file_id").alias("f")).select("target", F.when(F.col("n") == 1, F.col("f")).alias("file_id"), F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"))


@query(f"WITH {FILES_SQL}, {LINES_SQL} SELECT file_id, CAST(line_no AS BIGINT) AS line_no, line FROM lines WHERE file_id IN (1, 2, 3) AND line_no BETWEEN 2 AND 6")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-READ: a range of lines of some files."""
    return lines(files(spark, sf_dir).where(F.col("file_id").isin(1, 2, 3))).where(F.col("line_no").between(2, 6))


@query(
    """WITH l AS (SELECT o_custkey AS host, o_orderkey AS url_id, o_orderpriority AS pattern FROM orders), s AS (SELECT l_orderkey AS url_id FROM lineitem WHERE l_linenumber = 5)
    SELECT host, url_id FROM (SELECT l.*, row_number() OVER (PARTITION BY host, pattern ORDER BY url_id) AS r FROM l ANTI JOIN s USING (url_id)) WHERE r <= 2"""
)
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-ENQUEUE: frontier admission without what was seen, two variants of a pattern and host (the crawler's cap)."""
    l = table(spark, sf_dir, "orders").selectExpr("o_custkey host", "o_orderkey url_id", "o_orderpriority pattern")
    seen = table(spark, sf_dir, "lineitem").where("l_linenumber = 5").selectExpr("l_orderkey url_id")
    fresh = l.join(seen, "url_id", "left_anti")
    return fresh.withColumn("r", F.row_number().over(Window.partitionBy("host", "pattern").orderBy("url_id"))).where("r <= 2").select("host", "url_id")


@query(
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, [x FOR x IN string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/') IF x <> ''] AS seg FROM pages)
    SELECT page_id, host || '/' || array_to_string(list_slice(seg, 1, least(2, greatest(len(seg) - 1, 0))), '/') AS scope FROM u"""
)
def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-SCOPE: prefix of a crawl from its start url, two segments at most."""
    seg = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), seg.alias("seg"))
    return p.select("page_id", F.concat("host", F.lit("/"), F.array_join(F.slice("seg", F.lit(1), F.least(F.lit(2), F.greatest(F.size("seg") - 1, F.lit(0)))), "/")).alias("scope"))


@query(
    """WITH h AS (SELECT o_custkey AS q, o_orderstatus AS version, max(o_totalprice) AS best FROM orders GROUP BY ALL), c AS (SELECT q, best AS chosen FROM h WHERE version = 'O')
    SELECT q, arg_max(version, best) AS also_in, round(max(best), 2) AS score FROM h JOIN c USING (q) WHERE version <> 'O' AND best > chosen GROUP BY q"""
)
def also_in_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-ALSOIN and RNK-WEBFIND: the best hit of another version when it beats the chosen one.

    Of versions with equal best hits, the one that comes first in the table
    (in order of its keys) is named, as the SQL does on one thread; on several
    threads the SQL names either.
    """
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q"), F.col("o_orderstatus").alias("version")).agg(F.max("o_totalprice").alias("best"), (-F.min("o_orderkey")).alias("early"))
    own = h.groupBy("q").agg(F.max(F.when(F.col("version") == "O", F.col("best"))).alias("chosen"), F.max(F.when(F.col("version") != "O", F.struct("best", "early", "version"))).alias("x"))
    return own.where("chosen IS NOT NULL AND x.best > chosen").select("q", F.col("x.version").alias("also_in"), F.round("x.best", 2).alias("score"))


@query(
    """WITH touched AS (SELECT DISTINCT l_partkey AS sym FROM lineitem WHERE l_orderkey % 50 = 1), calls AS (SELECT DISTINCT l_suppkey AS caller, l_partkey AS sym FROM lineitem)
    SELECT caller, CAST(count(*) AS BIGINT) AS touched FROM calls SEMI JOIN touched USING (sym) GROUP BY caller"""
)
def changed_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-CHANGED: outside callers of touched symbols."""
    li = table(spark, sf_dir, "lineitem")
    touched = li.where("l_orderkey % 50 = 1").select(F.col("l_partkey").alias("sym")).distinct()
    calls = li.selectExpr("l_suppkey caller", "l_partkey sym").distinct()
    return calls.join(touched, "sym", "left_semi").groupBy("caller").agg(F.count(F.lit(1)).alias("touched"))


_UI = ["t('menu.open')", 'aria-label="Close dialog"', "export function Menu() {", "// t('not')", "<Trans i18nKey=\"a.b\">"]


@query(
    "WITH l AS (SELECT unnest(['" + "','".join(x.replace("'", "''") for x in _UI) + r"""']) AS line) SELECT line, regexp_matches(line, '^ *(//|/\*|#)') AS comment, CASE WHEN regexp_matches(line, '^ *(//|/\*|#)') THEN '' ELSE regexp_extract(line, '(?:\bt\(|i18nKey=)[''"]([^''"]+)', 1) END AS key, regexp_extract(line, 'aria-label="([^"]*)"', 1) AS aria, regexp_matches(line, 'function +[A-Z]') AS component FROM l"""
)
def i18n_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-I18N: translation keys, labels, components and comments by line."""
    c = F.col("line")
    comment = c.rlike(r"^ *(//|/\*|#)")
    return spark.createDataFrame([(x,) for x in _UI], "line string").select("line", comment.alias("comment"), F.when(comment, "").otherwise(F.regexp_extract(c, r"""(?:\bt\(|i18nKey=)['"]([^'"]+)""", 1)).alias("key"), F.regexp_extract(c, 'aria-label="([^"]*)"', 1).alias("aria"), c.rlike("function +[A-Z]").alias("component"))
