"""Text projections and line filters as queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators.scan import NULL_ID, worded
from lorekeep.plans.registry import query
from lorekeep.sources.tables import FILES_SQL, LINES_SQL, files, lines, table

_FOLD = f"replace(replace(replace(replace(translate({{0}}, '{tx.ACCENTED}', '{tx.PLAIN}'), 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'OE'), 'Æ', 'AE')"
_STOP = "['" + "','".join(tx.STOP) + "']"


@query(f"SELECT doc_id, sha256({_FOLD.format('text')}) AS folded_hash FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-FOLD: accents and ligatures off."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.fold(F.col("text")), 256).alias("folded_hash"))


@query(
    rf"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower({_FOLD.format("coalesce(text, '')")}), '[a-z]+')) AS term FROM documents)
    SELECT term, {tx.stem_sql('term')} AS stem FROM t"""
)
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-STEM: light stems of the folded vocabulary."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(tx.fold(F.coalesce("text", F.lit("")))), F.lit("([a-z]+)"), F.lit(1))).alias("term")).distinct()
    return t.select("term", tx.stem(F.col("term")).alias("stem"))


@query(
    rf"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower({_FOLD.format('text')}), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark)
    SELECT item_id, term, CAST(count(*) AS BIGINT) AS n FROM t WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT list_contains({_STOP}, term) GROUP BY ALL"""
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-FREE and TXT-QTERMS: folded content terms of the questions."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.free_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({_FOLD.format("coalesce(text, '')")}), '[a-z]+|[0-9]+')) AS term FROM documents),
    k AS (SELECT doc_id, {tx.stem_sql('term')} AS term FROM t WHERE length(term) BETWEEN 2 AND 40 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT list_contains({_STOP}, term))
    SELECT doc_id, term, CAST(least(count(*), 65535) AS BIGINT) AS tf FROM k GROUP BY ALL"""
)
def body_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-BODY: stemmed bag of words, split where letters and digits meet, counts clamped.

    Counted where the documents are read: each distinct word of a batch is
    judged and stemmed once.
    """
    words = F.regexp_extract_all(F.lower(tx.fold(F.coalesce("text", F.lit("")))), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    body = worded(table(spark, sf_dir, "documents"), "doc_id", body=words).select("id", "w_body")
    return body.mapInArrow(_bags, "doc_id bigint, term string, tf bigint").withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stop = frozenset(tx.STOP)
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            held = batch.column(1)
            coded = pc.dictionary_encode(held.flatten())
            known = coded.dictionary.to_pylist()
            stems = [tx.stem_word(w) if 2 <= len(w) <= 40 and not w.isdigit() and w not in stop else None for w in known]
            terms = pc.dictionary_encode(pa.array(stems, pa.string()))
            of_word = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            t = of_word[np.asarray(coded.indices, np.int64)]
            d = np.repeat(np.arange(len(held)), np.diff(np.asarray(held.offsets)))
            key, tf = np.unique(d[t >= 0] * max(1, len(terms.dictionary)) + t[t >= 0], return_counts=True)
            d, t = np.divmod(key, max(1, len(terms.dictionary)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), terms.dictionary.take(pa.array(t)), pa.array(np.minimum(tf, 65535).astype(np.int64))], names=["doc_id", "term", "tf"])


@query(None)
def ident_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-IDENT: parts of identifiers and the whole (customer names and page paths stand for them)."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "pages").select("url"))
    return names.select("name", tx.ident_tokens(F.col("name")).alias("tokens"))


@query(rf"SELECT item_id, trim(regexp_replace(lower({_FOLD.format('text')}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-') AS slug FROM benchmark")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-SLUG: heading to anchor."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS cost FROM documents")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-TOKENS: a quarter of the characters, rounded up."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_cost(F.coalesce("text", F.lit(""))).alias("cost"))


@query(
    f"""WITH {FILES_SQL}, h AS (SELECT file_id, path, split_part(text, ' ', 1) AS name FROM files)
    SELECT file_id, 'S:' || regexp_extract(path, '^[^/]*') || '#' || name || CASE WHEN r > 1 THEN '~' || r ELSE '' END AS stable_id
    FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(path, '^[^/]*'), name ORDER BY file_id) AS r FROM h)"""
)
def homonym_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-RANKID: ids of homonyms bear their rank from the second on."""
    h = files(spark, sf_dir).select("file_id", F.regexp_extract("path", "^[^/]*", 0).alias("folder"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"))
    r = F.row_number().over(Window.partitionBy("folder", "name").orderBy("file_id"))
    return h.select("file_id", F.concat(F.lit("S:"), "folder", F.lit("#"), "name", F.when(r > 1, F.concat(F.lit("~"), r.cast("string"))).otherwise("")).alias("stable_id"))


@query(
    r"""WITH u AS (SELECT unnest(['S:a/b.py#f~2', 'D:doc.md#top', 'F:src/x.rs', '`src/x.rs:10-20`', 'src/x.rs:7,', 'plainName']) AS raw), c AS (SELECT raw, trim(raw, '`"'',;()') AS t FROM u)
    SELECT raw, CASE WHEN starts_with(t, 'S:') THEN 'symbol' WHEN starts_with(t, 'D:') THEN 'doc' WHEN starts_with(t, 'F:') THEN 'file' WHEN regexp_matches(t, ':[0-9]+-[0-9]+$') THEN 'range' WHEN regexp_matches(t, ':[0-9]+$') THEN 'line' ELSE 'name' END AS kind,
    CASE WHEN regexp_matches(t, '^[SDF]:') THEN regexp_extract(t, '^[SDF]:([^#]*)', 1) WHEN regexp_matches(t, ':[0-9]') THEN regexp_extract(t, '^(.*):[0-9]+(-[0-9]+)?$', 1) ELSE t END AS target FROM c"""
)
def parse_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-PARSEID: kind and target of a pasted reference."""
    u = spark.createDataFrame([(x,) for x in ("S:a/b.py#f~2", "D:doc.md#top", "F:src/x.rs", "`src/x.rs:10-20`", "src/x.rs:7,", "plainName")], "raw string")
    t = F.btrim("raw", F.lit("`\"',;()"))
    kind = F.when(F.startswith(t, F.lit("S:")), "symbol").when(F.startswith(t, F.lit("D:")), "doc").when(F.startswith(t, F.lit("F:")), "file").when(t.rlike(":[0-9]+-[0-9]+$"), "range").when(t.rlike(":[0-9]+$"), "line").otherwise("name")
    target = F.when(t.rlike("^[SDF]:"), F.regexp_extract(t, "^[SDF]:([^#]*)", 1)).when(t.rlike(":[0-9]"), F.regexp_extract(t, "^(.*):[0-9]+(-[0-9]+)?$", 1)).otherwise(t)
    return u.select("raw", kind.alias("kind"), target.alias("target"))


@query(
    rf"""WITH {FILES_SQL} SELECT file_id, CASE WHEN regexp_matches(regexp_extract(text, '^[^.!?\n]*[.!?]?'), '^.{{161,}}') THEN regexp_extract(regexp_extract(text, '^[^.!?\n]*[.!?]?'), '^.{{0,160}}\b') ELSE regexp_extract(text, '^[^.!?\n]*[.!?]?') END IS NOT NULL AS has_summary, length(regexp_extract(text, '^[^.!?\n]*[.!?]?')) AS first_sentence FROM files"""
)
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-SUMMARY: length of a text's first sentence."""
    s = F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0)
    return files(spark, sf_dir).select("file_id", s.isNotNull().alias("has_summary"), F.char_length(s).cast("bigint").alias("first_sentence"))


@query(
    f"""WITH {FILES_SQL}, {LINES_SQL} SELECT file_id, CAST(sum(len(regexp_extract_all(line, '[^ ]+'))) FILTER (NOT regexp_matches(line, '^(#{{1,6}} |```)')) AS BIGINT) AS words FROM lines GROUP BY file_id"""
)
def substance_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-SUBSTANCE: words outside headings and fence lines."""
    ls = lines(files(spark, sf_dir))
    n = F.when(~F.col("line").rlike("^(#{1,6} |```)"), F.size(F.regexp_extract_all("line", F.lit("([^ ]+)"), F.lit(1))))
    return ls.groupBy("file_id").agg(F.sum(n).cast("bigint").alias("words"))


_MARKS = "['le', 'la', 'les', 'des', 'une', 'est', 'dans', 'pour', 'comment']"


@query(rf"SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') OR len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), {_MARKS})) > 0 AS french FROM documents")
def french_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-LANG-FR and HLP-LANGDETECT: a non-ASCII letter or a marker word."""
    marks = F.array(*[F.lit(x) for x in ("le", "la", "les", "des", "une", "est", "dans", "pour", "comment")])
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("text").rlike(r"[^\x00-\x7F]") | F.arrays_overlap(found, marks)).alias("french"))


GLOBS = ["src1*/en/*", "**/doc_?.txt", "src3/**", "*_1?.txt"]


@query("WITH " + FILES_SQL + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{tx.glob_regex(g)}')" for g in GLOBS) + ") AS t(pattern, re)) SELECT pattern, file_id FROM files JOIN g ON regexp_matches(path, re)")
def glob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-GLOB: files by glob; stars cross slashes."""
    hits = F.filter(F.array(*[F.when(F.col("path").rlike(tx.glob_regex(g)), F.lit(g)) for g in GLOBS]), lambda g: g.isNotNull())
    return files(spark, sf_dir).select("file_id", F.explode(hits).alias("pattern"))


@query(
    f"""WITH {FILES_SQL} SELECT file_id, path, CAST(CASE WHEN base = 'doc_1.txt' THEN 3 WHEN starts_with(base, 'doc_1') THEN 2 WHEN contains(base, 'doc_1') THEN 1 ELSE 0 END AS INTEGER) AS score
    FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM files) WHERE contains(lower(path), 'doc_1') ORDER BY score DESC, path LIMIT 50"""
)
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-FILES: best 50 files by path fragment: exact name 3, prefix 2, in the name 1."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    score = F.when(base == "doc_1.txt", 3).when(F.startswith(base, F.lit("doc_1")), 2).when(F.contains(base, F.lit("doc_1")), 1).otherwise(0)
    return files(spark, sf_dir).where(F.contains(F.lower("path"), F.lit("doc_1"))).select("file_id", "path", score.alias("score")).orderBy(F.desc("score"), "path").limit(50)


@query(f"WITH {FILES_SQL}, {LINES_SQL} SELECT file_id, CAST(line_no AS BIGINT) AS line_no, substring(trim(line), 1, 200) AS text FROM lines WHERE contains(lower(line), 'thing')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-GREP: lines that hold a literal, case folded, cut at 200 characters."""
    hit = lines(files(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("thing")))).where(F.contains(F.lower("line"), F.lit("thing")))
    return hit.select("file_id", "line_no", F.substring(F.trim("line"), 1, 200).alias("text"))


_SYMS = "syms AS (SELECT file_id, path, line_no AS first, coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no) - 1, 1000000) AS last, regexp_extract(line, '^[^ ]*') AS name FROM lines WHERE regexp_matches(line, '^[A-Z]') UNION ALL SELECT file_id, path, 1, 1000000, 'file' FROM files)"


@query(
    f"""WITH {FILES_SQL}, {LINES_SQL}, {_SYMS} SELECT l.file_id, CAST(l.line_no AS BIGINT) AS line_no, arg_min(name, last - first) AS symbol
    FROM lines l JOIN syms s ON s.file_id = l.file_id AND l.line_no BETWEEN first AND last WHERE contains(lower(line), 'thing') OR contains(lower(line), 'stion') GROUP BY ALL"""
)
def grep_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-GREP-SYM: matching lines with the innermost symbol around them.

    Symbols are laid end to end, so the innermost one is the last that opened:
    one pass over a file's lines carries it forward.
    """
    ls = lines(files(spark, sf_dir))
    opens = F.when(F.col("line").rlike("^[A-Z]"), F.regexp_extract("line", "^[^ ]*", 0))
    around = F.last(opens, True).over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    # a symbol that is its whole file gives way to the file
    spans = F.count(opens).over(Window.partitionBy("file_id")), F.min(F.when(opens.isNotNull(), F.col("line_no"))).over(Window.partitionBy("file_id"))
    named = ls.select("file_id", "line_no", "line", around.alias("around"), spans[0].alias("opened"), spans[1].alias("first"))
    symbol = F.when(F.col("around").isNull() | (F.col("opened") == 1) & (F.col("first") == 1), "file").otherwise(F.col("around"))
    return named.select("file_id", "line_no", "line", symbol.alias("symbol")).where(F.lower("line").rlike("thing|stion")).select("file_id", "line_no", "symbol")


@query(
    r"""WITH l AS (SELECT event_id, '  ' || event_type || ' took ' || CAST(user_id AS VARCHAR) || ' ms   at step_' || (event_id % 7) || ' ' || props AS line FROM events),
    n AS (SELECT regexp_replace(regexp_replace(substring(trim(line), 1, 160), '\b[0-9]+\b', '#', 'g'), '[ _]{2,}', '  ', 'g') AS shape FROM l) SELECT shape, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY shape"""
)
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-NORMLINE: log lines by shape."""
    line = F.concat(F.lit("  "), "event_type", F.lit(" took "), F.col("user_id").cast("string"), F.lit(" ms   at step_"), (F.col("event_id") % 7).cast("string"), F.lit(" "), "props")
    return table(spark, sf_dir, "events").select(tx.norm_line(line).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS files, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY lang")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-STATS: files, lines and characters by language."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split(t, "\n", -1))).cast("bigint").alias("lines"), F.sum(F.char_length(t)).cast("bigint").alias("chars"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS size, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines FROM documents WHERE NOT contains(coalesce(text, ''), chr(0))")
def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-READ: hash, size and lines of each file without NUL."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").where(~F.contains(t, F.lit("\0"))).select("doc_id", F.sha2(t, 256).alias("hash"), F.octet_length(t).cast("bigint").alias("size"), F.size(F.split(t, "\n", -1)).cast("bigint").alias("lines"))
