"""Small rules on whole tables: baseline tokens, documentation addresses, language parameters, coverage of the best hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators.retrieval import EXPECTED_SQL, SCORES_SQL, bm25_score, bodies, confidence_abstain, each_block, expected, idf, question_terms, top
from lorekeep.operators.scan import Asked, Held, scored, stats
from lorekeep.operators.textops import _FOLD
from lorekeep.plans.registry import ORACLE_SQL, query
from lorekeep.sources.tables import FILES_SQL, files, table

#: Where a token parts: at a change of case, and between letters and digits; replaced one after the other.
EDGES = [(r"(\p{Ll})(\p{Lu})", 2), (r"(\p{Lu})(\p{Lu}\p{Ll})", 2), (r"(\p{L})([0-9])", 2), (r"([0-9])(\p{L})", 2)]


def lex_tokens(c):
    """Baseline tokens: accents folded, split at edges, two characters at least, no stems and no stop words."""
    c = tx.fold(c)
    for pattern, _ in EDGES:
        c = F.regexp_replace(c, pattern, "$1 $2")
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(tx.WORDS), F.lit(1)), lambda t: F.char_length(t) >= 2)


_LEX = _FOLD.format("coalesce(text, '')")
for _pattern, _ in EDGES:
    _LEX = rf"regexp_replace({_LEX}, '{_pattern}', '\1 \2', 'g')"


@query(rf"WITH t AS (SELECT unnest(regexp_extract_all(lower({_LEX}), '[\p{{L}}\p{{N}}]+')) AS term FROM documents) SELECT term, CAST(count(*) AS BIGINT) AS n FROM t WHERE length(term) >= 2 GROUP BY term")
def lex_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-LEX: how often each baseline token stands in all documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(lex_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


#: Addresses of documentation by ecosystem.
_DEPS_SQL = "d AS (SELECT p_partkey AS dep, p_partkey % 4 AS eco, replace(lower(p_name), ' ', '-') AS n, CAST(p_size AS VARCHAR) || '.0.' || CAST(p_partkey % 7 AS VARCHAR) AS v FROM part)"


@query(
    f"""WITH {_DEPS_SQL} SELECT dep, 2 AS tier, 'docs.rs' AS kind, 'https://docs.rs/' || n || '/' || v || '/' || replace(n, '-', '_') || '/' AS url FROM d WHERE eco = 0
    UNION ALL SELECT dep, 1, 'crates.io-meta', 'https://crates.io/api/v1/crates/' || n || '/' || v FROM d WHERE eco = 0
    UNION ALL SELECT dep, 1, 'npm-meta', 'https://registry.npmjs.org/' || replace(n, '/', '%2F') || '/' || v FROM d WHERE eco = 1
    UNION ALL SELECT dep, 1, 'pypi-meta', 'https://pypi.org/pypi/' || n || '/' || v || '/json' FROM d WHERE eco = 2
    UNION ALL SELECT dep, 2, 'pkg.go.dev', 'https://pkg.go.dev/' || n || '@' || v FROM d WHERE eco = 3"""
)
def doc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-DOCCAND: candidate documentation addresses of each dependency (here a part) by ecosystem."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_partkey").alias("dep"), (F.col("p_partkey") % 4).alias("eco"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("n"), F.concat(F.col("p_size").cast("string"), F.lit(".0."), (F.col("p_partkey") % 7).cast("string")).alias("v"))
    n, v = F.col("n"), F.col("v")
    at = lambda tier, kind, *url: F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.concat(*[F.lit(u) if isinstance(u, str) else u for u in url]).alias("url"))
    found = (
        F.when(F.col("eco") == 0, F.array(at(2, "docs.rs", "https://docs.rs/", n, "/", v, "/", F.replace(n, F.lit("-"), F.lit("_")), "/"), at(1, "crates.io-meta", "https://crates.io/api/v1/crates/", n, "/", v)))
        .when(F.col("eco") == 1, F.array(at(1, "npm-meta", "https://registry.npmjs.org/", F.replace(n, F.lit("/"), F.lit("%2F")), "/", v)))
        .when(F.col("eco") == 2, F.array(at(1, "pypi-meta", "https://pypi.org/pypi/", n, "/", v, "/json")))
        .otherwise(F.array(at(2, "pkg.go.dev", "https://pkg.go.dev/", n, "@", v)))
    )
    return d.select("dep", F.explode(found).alias("x")).select("dep", "x.tier", "x.kind", "x.url")


#: Query parameters that name a language.
LANG_PARAMS = ["locale", "lang", "hl", "language", "lng"]
_PARAM = f"^(?:{'|'.join(LANG_PARAMS)})="
_URL_SQL = r"u AS (SELECT page_id, url || CASE WHEN page_id % 5 = 4 THEN '' WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE page_id % 5 WHEN 0 THEN 'lang=FR&p=1' WHEN 1 THEN 'p=2&hl=en-US' WHEN 2 THEN 'locale=de' WHEN 3 THEN 'q=lang' ELSE '' END AS url FROM pages WHERE url IS NOT NULL)"


@query(
    rf"""WITH {_URL_SQL}, s AS (SELECT page_id, url, regexp_extract(url, '^[^?]*') AS base, string_split(regexp_extract(url, '^[^?]*\?(.*)$', 1), '&') AS q FROM u),
    k AS (SELECT page_id, base, list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '{_PARAM}')) AS kept, list_filter(q, lambda x: regexp_matches(x, '{_PARAM}'))[1] AS asked FROM s)
    SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url, asked IS NOT NULL AS has_lang,
      asked IS NOT NULL AND NOT starts_with(lower(split_part(asked, '=', 2)), 'en') AS skip FROM k"""
)
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-LANGQUERY: language parameters leave a url; one that asks for another language than English is skipped."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("lang=FR&p=1", "p=2&hl=en-US", "locale=de", "q=lang", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    joint = F.when(F.col("page_id") % 5 == 4, "").when(F.contains("url", F.lit("?")), "&").otherwise("?")
    parts = F.split(F.concat("url", joint, tail), r"\?", 2)
    s = p.select("page_id", parts[0].alias("base"), F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "&").alias("q"))
    k = s.select("page_id", "base", F.filter("q", lambda x: (x != "") & ~x.rlike(_PARAM)).alias("kept"), F.get(F.filter("q", lambda x: x.rlike(_PARAM)), F.lit(0)).alias("asked"))
    url = F.concat("base", F.when(F.size("kept") > 0, F.concat(F.lit("?"), F.array_join("kept", "&"))).otherwise(""))
    other = F.col("asked").isNotNull() & ~F.startswith(F.lower(F.split_part("asked", F.lit("="), F.lit(2))), F.lit("en"))
    return k.select("page_id", url.alias("url"), F.col("asked").isNotNull().alias("has_lang"), other.alias("skip"))


@query(
    f"""WITH {SCORES_SQL}, i AS (SELECT term, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf FROM (SELECT DISTINCT term FROM qt) LEFT JOIN df USING (term) CROSS JOIN stat),
    t AS (SELECT item_id, sum(idf) AS den FROM qt JOIN i USING (term) GROUP BY item_id), b AS (SELECT item_id, doc_id FROM ranked WHERE rank = 1),
    c AS (SELECT b.item_id, sum(idf) AS num FROM b JOIN qt USING (item_id) JOIN post ON post.doc_id = b.doc_id AND post.term = qt.term JOIN i ON i.term = qt.term GROUP BY b.item_id)
    SELECT item_id, round(coalesce(num, 0) / den, 6) AS coverage FROM t LEFT JOIN c USING (item_id)"""
)
def best_hit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLP-WCOV: idf-weighted share of a question's words that its best hit holds."""
    body = bodies(table(spark, sf_dir, "documents"))

    def made(asked: Asked) -> DataFrame:
        st = stats(body, asked)
        weight, ranked = idf(st), bm25_score(asked, st)
        den = spark.createDataFrame(pa.table({"item_id": asked.items, "den": asked.total(weight)}))

        def score(held: list[Held], n: int) -> tuple[np.ndarray, ...]:
            hit, s = ranked(held, n)
            return hit, s, asked.cells(held[0].d, held[0].t, n, weight[held[0].t])

        best = top(scored(body, asked, score, ["score", "num"], 1), 1).select("item_id", "num")
        return den.join(best, "item_id", "left")

    return each_block(question_terms(table(spark, sf_dir, "benchmark")), made).select("item_id", F.round(F.coalesce("num", F.lit(0.0)) / F.col("den"), 6).alias("coverage"))


THRESHOLDS = [k / 10 for k in range(1, 10)]


@query(
    f"""WITH conf AS ({ORACLE_SQL['confidence_abstain']}), {EXPECTED_SQL}, a AS (SELECT confidence, item_id IN (SELECT item_id FROM expected) AS answerable FROM conf), t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(count(*) FILTER (confidence < threshold AND NOT answerable) AS BIGINT) AS right_refusals, CAST(count(*) FILTER (confidence < threshold AND answerable) AS BIGINT) AS wrong_refusals, CAST(count(*) FILTER (confidence >= threshold AND answerable) AS BIGINT) AS answered FROM a CROSS JOIN t GROUP BY threshold"""
)
def abstention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-ABST: refusals by threshold, of questions that a document answers and of those that none does."""
    docs, bm = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    known = expected(docs, bm).select("item_id").distinct().withColumn("answerable", F.lit(True))
    a = confidence_abstain(spark, sf_dir).join(known, "item_id", "left").select("confidence", F.coalesce("answerable", F.lit(False)).alias("answerable"), F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    low = F.col("confidence") < F.col("threshold")
    return a.groupBy("threshold").agg(F.count_if(low & ~F.col("answerable")).alias("right_refusals"), F.count_if(low & F.col("answerable")).alias("wrong_refusals"), F.count_if(~low & F.col("answerable")).alias("answered"))


#: Endings dealt to the files, whose own is always txt.
ENDINGS = ["txt", "sql", "YML", "yaml.bak", "toml", "Json", "jsonl"]


@query(
    rf"""WITH {FILES_SQL}, p AS (SELECT file_id, regexp_replace(path, '[^.]*$', '') || ['{"', '".join(ENDINGS)}'][CAST(file_id % {len(ENDINGS)} AS INTEGER) + 1] AS path FROM files)
    SELECT file_id, path, regexp_matches(path, '{tx.CONFIG_PATH}') AS config FROM p"""
)
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-ISCONFIG: whether each path is that of a configuration or schema file."""
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("file_id") % len(ENDINGS) + 1).cast("int"))
    p = files(spark, sf_dir).select("file_id", F.concat(F.regexp_replace("path", "[^.]*$", ""), ending).alias("path"))
    return p.select("file_id", "path", tx.is_config(F.col("path")).alias("config"))
