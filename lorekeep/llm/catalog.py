"""The training-data queries, over whole tables, and the SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.decontaminate import find_contamination

    found = find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.quality import score_quality

    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.html_text import extract

    return extract(load(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.exact_dedup import exact_groups

    return exact_groups(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"))


#: Two turns that hold the control strings of a template as plain text.
CONTROL_CASE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.chat import format_windows, read_back
    from lorekeep.llm.common import stash

    case = spark.createDataFrame(CONTROL_CASE, "conv_id bigint, turn bigint, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    return read_back(stash(format_windows(rows), "windows"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.substrings import dedup_substrings

    return dedup_substrings(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.warc import round_trip

    read = round_trip(load(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.secrets import find_secrets

    return find_secrets(load(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.jaccard import near_groups

    return near_groups(load(spark, sf_dir, "documents"), size=3, threshold=90)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_chat, op3_substrings, op4_warc, op5_quality, op6_html_text, op7_exact_dedup, op8_packing, op9_secrets, op10_ngram_jaccard)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_substrings": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM w, unnest(range(1, len(w) - 18)) AS r(i)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
        words AS (SELECT doc_id, i AS j, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.s, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
              FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
        c AS (SELECT a, least(a, min(b)) AS low FROM reach GROUP BY a)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS low FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN low <> page_id THEN low END AS refers_to FROM f""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op1_decontaminate": f"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS t
                FROM bw, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT m FROM win),
        pos AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t
                FROM dw CROSS JOIN sizes, unnest(range(1, len(w) - m + 2)) AS r(i)),
        hit AS (SELECT DISTINCT doc_id, item, i, m FROM pos JOIN win USING (m, t)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
               coalesce(items.n, 0) >= 2 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
