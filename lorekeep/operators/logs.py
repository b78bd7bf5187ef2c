"""Log and stack analytics on log lines, with failure blocks, frames and source maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

#: Log lines that stand for a run: events with texts by their remainder.
LINE_SQL = r"""CASE event_id % 9 WHEN 0 THEN 'ERROR in step ' || (event_id % 4) || ': value ' || user_id WHEN 1 THEN '  at load (src/app.ts:' || user_id || ':7)' WHEN 2 THEN 'warning: unused variable x' || (user_id % 3) WHEN 3 THEN 'ok ' || event_id || ' - renders'
 WHEN 4 THEN 'FAILED tests/test_a.py::test_' || (user_id % 5) WHEN 5 THEN '    expected 1 but got ' || user_id WHEN 6 THEN '3 passed, 1 failed in 2.1s' WHEN 7 THEN 'File "/srv/app.py", line ' || user_id || ', in handler' ELSE 'info: ' || event_type END"""
_LOG_SQL = f"log AS (SELECT event_id % 40 AS file, event_id AS line_no, {LINE_SQL} AS line FROM events)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.expr(LINE_SQL)
    return e.select((F.col("event_id") % 40).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


#: Our own pattern ladder: headers of failures, details below them, warnings, summaries, passing tests.
HEADER = r"^(ERROR|FAILED|FAIL|panicked|Traceback|error(\[[A-Z0-9]+\])?:|--- FAIL)"
DETAIL = r"^ +(at |expected|received|assert|-->|\d+ \|)|^E  |^File "
WARN = r"^(warning|WARN|warn)"
SUMMARY = r"\d+ (passed|failed|tests?|errors?)"
PASS = r"^(ok|PASS|✓|test .* \.\.\. ok)"


def line_class_of(c):
    return F.when(c.rlike(HEADER), 3).when(c.rlike(DETAIL), 2).when(c.rlike(WARN), 1).otherwise(0)


_CLASS_SQL = rf"CASE WHEN regexp_matches(line, '{HEADER}') THEN 3 WHEN regexp_matches(line, '{DETAIL}') THEN 2 WHEN regexp_matches(line, '{WARN}') THEN 1 ELSE 0 END"


@query(f"WITH {_LOG_SQL} SELECT file, line_no, CAST({_CLASS_SQL} AS INTEGER) AS class, regexp_matches(line, '{SUMMARY}') AS summary, regexp_matches(line, '{PASS}') AS success FROM log")
def line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-CLASS and FLT-SUCCESS: class of each line, summary and success flags."""
    c = F.col("line")
    return log_lines(spark, sf_dir).select("file", "line_no", line_class_of(c).alias("class"), c.rlike(SUMMARY).alias("summary"), c.rlike(PASS).alias("success"))


_SHAPE_SQL = r"regexp_replace(regexp_replace(substring(trim({0}), 1, 160), '\b[0-9]+\b', '#', 'g'), '[ _]{{2,}}', '  ', 'g')"


@query(
    f"""WITH {_LOG_SQL}, h AS (SELECT file, line_no, line, lead(line) OVER (PARTITION BY file ORDER BY line_no) AS next FROM log), b AS (SELECT * FROM h WHERE regexp_matches(line, '{HEADER}'))
    SELECT {_SHAPE_SQL.format('line')} || chr(10) || {_SHAPE_SQL.format("coalesce(next, '')")} AS block_key, CAST(count(*) AS BIGINT) AS n, CAST(min(line_no) AS BIGINT) AS first_line FROM b GROUP BY block_key"""
)
def block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-DEDUP: failure blocks by the shape of their header and next line."""
    nxt = F.lead("line").over(Window.partitionBy("file").orderBy("line_no"))
    b = log_lines(spark, sf_dir).withColumn("next", nxt).where(F.col("line").rlike(HEADER))
    key = F.concat(tx.norm_line(F.col("line")), F.lit("\n"), tx.norm_line(F.coalesce("next", F.lit(""))))
    return b.groupBy(key.alias("block_key")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def blocks_of(lines: pd.DataFrame, most: int = 20) -> pd.DataFrame:
    """Blocks of a file: a header and what follows it while details last, at most `most` lines."""
    out, start, last = [], None, None
    for r in lines.sort_values("line_no").itertuples(index=False):
        if r.cls == 3:
            if start is not None:
                out.append((r.file, start, last))
            start = last = r.line_no
            n = 1
        elif start is not None:
            if r.cls == 2 and n < most:
                last, n = r.line_no, n + 1
            else:
                out.append((r.file, start, last))
                start = None
    if start is not None:
        out.append((lines["file"].iloc[0], start, last))
    return pd.DataFrame(out, columns=["file", "first_line", "last_line"])


@query(None)
def failure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-BLOCK: failure blocks of each log.

    Sequential by its definition but for the run of details: gaps and islands
    say it with windows, without a group in a task's memory.
    """
    log = log_lines(spark, sf_dir).select("file", "line_no", line_class_of(F.col("line")).alias("cls"))
    w = Window.partitionBy("file").orderBy("line_no")
    marked = log.withColumn("head", F.last(F.when(F.col("cls") == 3, F.col("line_no")), True).over(w)).where("head IS NOT NULL")
    inner = Window.partitionBy("file", "head").orderBy("line_no")
    alive = marked.withColumn("broken", F.max((~F.col("cls").isin(2, 3)).cast("int")).over(inner)).withColumn("k", F.row_number().over(inner))
    return alive.where("broken = 0 AND k <= 20").groupBy("file", F.col("head").alias("first_line")).agg(F.max("line_no").alias("last_line"))


@query(
    rf"""WITH {_LOG_SQL}, f AS (SELECT file, line_no, regexp_extract(line, '^ *at ([^ ]+) \(', 1) || regexp_extract(line, ', in ([a-z]+)$', 1) AS fn, regexp_extract(line, '\(([^:]+):[0-9]+:', 1) || regexp_extract(line, 'File "([^"]+)"', 1) AS url,
    TRY_CAST(regexp_extract(line, '(:|line )([0-9]+)', 2) AS BIGINT) AS at_line FROM log WHERE regexp_matches(line, '^ *at .*\(.*:[0-9]+:[0-9]+\)$|^File ".*", line [0-9]+')) SELECT *, CASE WHEN starts_with(url, 'src/') THEN 'project' WHEN contains(url, 'node_modules') THEN 'lib' ELSE 'unknown' END AS origin FROM f"""
)
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRC-PARSE and TRC-RESOLVE: frames of two dialects, with where they come from."""
    c = F.col("line")
    f = log_lines(spark, sf_dir).where(c.rlike(r'^ *at .*\(.*:[0-9]+:[0-9]+\)$|^File ".*", line [0-9]+'))
    f = f.select("file", "line_no", F.concat(F.regexp_extract(c, r"^ *at ([^ ]+) \(", 1), F.regexp_extract(c, ", in ([a-z]+)$", 1)).alias("fn"), F.concat(F.regexp_extract(c, r"\(([^:]+):[0-9]+:", 1), F.regexp_extract(c, 'File "([^"]+)"', 1)).alias("url"), F.regexp_extract(c, "(:|line )([0-9]+)", 2).try_cast("bigint").alias("at_line"))
    return f.withColumn("origin", F.when(F.startswith("url", F.lit("src/")), "project").when(F.contains("url", F.lit("node_modules")), "lib").otherwise("unknown"))


@query(
    f"""WITH {_LOG_SQL}, s AS (SELECT file, line_no, 1.0 * (contains(line, 'value'))::INT + 0.6 * (contains(line, 'expected'))::INT + CASE WHEN regexp_matches(line, '{HEADER}') THEN 1000 ELSE 0 END AS own FROM log),
    m AS (SELECT *, own + 0.25 * (coalesce(lag(own) OVER w, 0) + coalesce(lead(own) OVER w, 0)) AS score FROM s WINDOW w AS (PARTITION BY file ORDER BY line_no)) SELECT file, line_no, round(score::DOUBLE, 4) AS score FROM m WHERE score > 0"""
)
def log_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-QUESTION and GR-READAROUND: line scores, failures first, smoothed over neighbours."""
    w = Window.partitionBy("file").orderBy("line_no")
    own = F.contains("line", F.lit("value")).cast("int") * 1.0 + F.contains("line", F.lit("expected")).cast("int") * 0.6 + F.when(F.col("line").rlike(HEADER), 1000).otherwise(0)
    s = log_lines(spark, sf_dir).select("file", "line_no", own.alias("own"))
    score = F.col("own") + 0.25 * (F.coalesce(F.lag("own").over(w), F.lit(0.0)) + F.coalesce(F.lead("own").over(w), F.lit(0.0)))
    return s.withColumn("score", score).where("score > 0").select("file", "line_no", F.round("score", 4).alias("score"))


@query(
    f"""WITH {_LOG_SQL} SELECT file, CAST(count(*) AS BIGINT) AS lines, arg_min(line, line_no) AS head, arg_max(line, line_no) AS tail, CAST(count(*) FILTER (regexp_matches(line, '{SUMMARY}')) AS BIGINT) AS summaries FROM log GROUP BY file"""
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-SUMMARY: head, tail and summary lines of each log."""
    return log_lines(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.min_by("line", "line_no").alias("head"), F.max_by("line", "line_no").alias("tail"), F.count_if(F.col("line").rlike(SUMMARY)).alias("summaries"))


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def vlq(segment: str) -> list[int]:
    """Signed numbers of one base-64 VLQ segment."""
    out, value, shift = [], 0, 0
    for ch in segment:
        digit = _DIGITS.index(ch)
        value |= (digit & 31) << shift
        if digit & 32:
            shift += 5
        else:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return out


def decode_mappings(mappings: str) -> list[tuple[int, int, int | None, int | None, int | None]]:
    """(generated line, column, source, line, column) of a version-3 source map."""
    out, state = [], [0, 0, 0, 0]
    for line_no, line in enumerate(mappings.split(";")):
        col = 0
        for segment in filter(None, line.split(",")):
            n = vlq(segment)
            col += n[0]
            if len(n) >= 4:
                state[0], state[1], state[2] = state[0] + n[1], state[1] + n[2], state[2] + n[3]
                out.append((line_no, col, *state[:3]))
            else:
                out.append((line_no, col, None, None, None))
    return out


MAPS = [("a.js", "AAAA,IAAM;AACA,QAAQ"), ("b.js", ";;AAEC,CAAC,EAAE")]


@query(None)
def vlq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRC-MAP: source-map mappings as rows; a map is decoded whole, maps are spread."""

    def run(batches):
        for pdf in batches:
            rows = [(r.script, *m) for r in pdf.itertuples() for m in decode_mappings(r.mappings)]
            yield pd.DataFrame(rows, columns=["script", "gen_line", "gen_col", "source", "line", "col"]).astype({"source": "Int64", "line": "Int64", "col": "Int64"})

    return spark.createDataFrame(MAPS, "script string, mappings string").mapInPandas(run, "script string, gen_line int, gen_col int, source bigint, line bigint, col bigint")


@query(
    rf"""WITH {_LOG_SQL}, e AS (SELECT line || chr(27) || '[31m' || file || chr(27) || '[0m' AS raw FROM log) SELECT regexp_replace(raw, chr(27) || '\[[0-9;?]*[A-Za-z]', '', 'g') AS plain, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY plain"""
)
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-ANSI: colour codes off."""
    raw = F.concat("line", F.lit("\x1b[31m"), F.col("file").cast("string"), F.lit("\x1b[0m"))
    return log_lines(spark, sf_dir).groupBy(tx.strip_ansi(raw).alias("plain")).agg(F.count(F.lit(1)).alias("n"))
