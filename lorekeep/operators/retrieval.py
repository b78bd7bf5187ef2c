"""Ranked retrieval: BM25 and fielded BM25, term matching, dense search, fusion.

Question sets are the benchmark table. Documents are scored where they are
read (scan.py): two passes over them, the first for the statistics of the
questions' words, and what is exchanged are the best hits of each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators.scan import Asked, Held, Stats, asked_blocks, containing, rounded, scored, stats, worded
from lorekeep.plans.registry import query
from lorekeep.sources.tables import FILES_SQL, LINES_SQL, files, lines, table

K1, B = 1.2, 0.75

QUESTIONS_SQL = r"""q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS terms FROM benchmark),
 qt AS (SELECT item_id, unnest(terms) AS term FROM q)"""
BODY_SQL = r"""body AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
 stat AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM body),
 tok AS (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM body),
 post AS (SELECT doc_id, any_value(doc_len) AS doc_len, term, count(*) AS tf FROM tok SEMI JOIN qt USING (term) GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
SCORES_SQL = f"""{QUESTIONS_SQL}, {BODY_SQL},
 score AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * doc_len / avg_len))), 4) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) CROSS JOIN stat GROUP BY item_id, doc_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score)"""


def question_terms(bm: DataFrame) -> DataFrame:
    return bm.select("item_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term"))


def bodies(docs: DataFrame) -> DataFrame:
    return worded(docs, "doc_id", body=tx.words(F.coalesce("text", F.lit(""))))


def idf(s: Stats, f: int = 0) -> np.ndarray:
    """ln(1 + (N-df+.5)/(df+.5)) of each asked word."""
    return np.log(1 + (s.n - s.df[f] + 0.5) / (s.df[f] + 0.5))


def bm25_score(asked: Asked, s: Stats, k1: float = K1, b: float = B) -> Callable:
    """Which document holds a word of which question, and its score."""
    weight, mean = idf(s), s.words[0] / max(1, s.n)

    def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray]:
        (h,) = held
        part = weight[h.t] * h.tf * (k1 + 1) / (h.tf + k1 * (1 - b + b * h.length[h.d] / mean))
        return asked.cells(h.d, h.t, n) > 0, rounded(asked.cells(h.d, h.t, n, part), 4)

    return score


def grep_score(asked: Asked) -> Callable:
    """Which document holds a word of which question, how often, and how many distinct ones."""

    def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (h,) = held
        words = asked.cells(h.d, h.t, n)
        return words > 0, asked.cells(h.d, h.t, n, h.tf), words

    return score


def each_block(terms: DataFrame, made: Callable[[Asked], DataFrame]) -> DataFrame:
    out = None
    for asked in asked_blocks(terms):
        out = made(asked) if out is None else out.unionByName(made(asked))
    return out


def bm25(docs: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, best: int | None = None) -> DataFrame:
    """(item_id, doc_id, score) of every matching pair, or of those that can be among the best; idf = ln(1 + (N-df+.5)/(df+.5))."""
    body = bodies(docs)
    return each_block(terms, lambda asked: scored(body, asked, bm25_score(asked, stats(body, asked), k1, b), ["score"], best))


def top(scores: DataFrame, k: int, group: str = "item_id", item: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"WITH {SCORES_SQL} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-BM25: Okapi BM25, ties by document id."""
    return top(bm25(table(spark, sf_dir, "documents"), question_terms(table(spark, sf_dir, "benchmark")), best=20), 20)


EXPECTED_SQL = "expected AS (SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def expected(docs: DataFrame, bm: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that hold the question's text literally."""
    return containing(docs, bm)


@query(
    f"""WITH {SCORES_SQL}, {EXPECTED_SQL},
    hit AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN expected e USING (item_id) LEFT JOIN ranked r ON r.item_id = e.item_id AND r.doc_id = e.doc_id AND r.rank <= 20 GROUP BY b.item_id)
    SELECT CAST(count(*) AS BIGINT) AS questions, CAST(count(*) FILTER (rank = 1) AS BIGINT) AS top1, CAST(count(*) FILTER (rank <= 5) AS BIGINT) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM hit"""
)
def bm25_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-RANK and AGG-METRICS of BM25: first expected rank up to 20, top-1, top-5, MRR."""
    docs, bm = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = top(bm25(docs, question_terms(bm), best=20), 20)
    rank = bm.select("item_id").join(expected(docs, bm).join(ranked, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("rank")), "item_id", "left")
    return rank.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


GREP_SQL = f"{QUESTIONS_SQL}, {BODY_SQL}, grep AS (SELECT item_id, doc_id, CAST(sum(tf) AS BIGINT) AS matches, CAST(count(*) AS BIGINT) AS distinct_words FROM qt JOIN post USING (term) GROUP BY item_id, doc_id)"


def grep_counts(docs: DataFrame, terms: DataFrame, order: list[str], best: int) -> DataFrame:
    """(item_id, doc_id, matches, distinct_words) of the pairs that can be among the best by the columns of the order."""
    body, names = bodies(docs), ["matches", "distinct_words"]

    def made(asked: Asked) -> DataFrame:
        score = grep_score(asked)

        def ordered(held: list[Held], n: int) -> tuple[np.ndarray, ...]:
            hit, *values = score(held, n)
            return hit, *[values[names.index(x)] for x in [*order, *(x for x in names if x not in order)]]

        return scored(body, asked, ordered, [*order, *(x for x in names if x not in order)], best, len(order))

    return each_block(terms, made).select("item_id", "doc_id", *[F.col(x).cast("bigint").alias(x) for x in names])


def _ranked(df: DataFrame, *order, k: int = 20) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)


@query(f"WITH {GREP_SQL} SELECT item_id, doc_id, matches, CAST(row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS INTEGER) AS rank FROM grep QUALIFY rank <= 20")
def grep_count_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-GREPRANK (a): by total matches."""
    counts = grep_counts(table(spark, sf_dir, "documents"), question_terms(table(spark, sf_dir, "benchmark")), ["matches"], 20)
    return _ranked(counts, F.desc("matches"), "doc_id").select("item_id", "doc_id", "matches", "rank")


@query(f"WITH {GREP_SQL} SELECT item_id, doc_id, distinct_words, matches, CAST(row_number() OVER (PARTITION BY item_id ORDER BY distinct_words DESC, matches DESC, doc_id) AS INTEGER) AS rank FROM grep QUALIFY rank <= 20")
def grep_terms_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-GREPRANK (b): by distinct words, then matches."""
    counts = grep_counts(table(spark, sf_dir, "documents"), question_terms(table(spark, sf_dir, "benchmark")), ["distinct_words", "matches"], 20)
    return _ranked(counts, F.desc("distinct_words"), F.desc("matches"), "doc_id").select("item_id", "doc_id", "distinct_words", "matches", "rank")


FUSED_SQL = f"""{SCORES_SQL}, grep AS (SELECT item_id, doc_id, sum(tf) AS matches, count(*) AS distinct_words FROM qt JOIN post USING (term) GROUP BY item_id, doc_id),
 lists AS (SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 50 UNION ALL
  SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY distinct_words DESC, matches DESC, doc_id) AS rank FROM grep QUALIFY rank <= 50),
 fused AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score, min(rank) AS best FROM lists GROUP BY item_id, doc_id)"""


def rrf(lists: DataFrame, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists laid end to end."""
    return lists.groupBy("item_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best"))


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, terms = table(spark, sf_dir, "documents"), question_terms(table(spark, sf_dir, "benchmark"))
    a = top(bm25(docs, terms, best=50), 50).select("item_id", "doc_id", "rank")
    b = _ranked(grep_counts(docs, terms, ["distinct_words", "matches"], 50), F.desc("distinct_words"), F.desc("matches"), "doc_id", k=50).select("item_id", "doc_id", "rank")
    return a, b


@query(f"WITH {FUSED_SQL} SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best, doc_id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-RRF: sum of 1/(60+rank); ties by best rank, then id."""
    a, b = _two_lists(spark, sf_dir)
    return _ranked(rrf(a.unionByName(b)), F.desc("score"), "best", "doc_id").select("item_id", "doc_id", "score", "rank")


@query(
    f"""WITH {FUSED_SQL}, top20 AS (SELECT item_id, doc_id FROM ranked WHERE rank <= 20)
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best, doc_id) AS INTEGER) AS rank FROM fused SEMI JOIN top20 USING (item_id, doc_id)"""
)
def rerank20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-RERANK: only the first list's top 20, in fused order."""
    a, b = _two_lists(spark, sf_dir)
    fused = rrf(a.unionByName(b)).join(a.where("rank <= 20").select("item_id", "doc_id"), ["item_id", "doc_id"], "left_semi")
    return _ranked(fused, F.desc("score"), "best", "doc_id", k=20).select("item_id", "doc_id", "score", "rank")


@query(
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 5) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-DENSE: exact cosine neighbours of the query vectors (ids divisible by 50), ties by id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 50 = 0"), 10)


#: Vectors and query vectors of a block, about.
VECTORS, ASKING = 8192, 4096


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, e): about `rows` vectors a row, by id; ids as 64-bit integers, vectors as doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [np.zeros(0, np.int64)], []
        for batch in batches:
            ids.append(np.asarray(batch.column(0), np.int64))
            held = np.asarray(batch.column(1).is_valid())
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(int(held.sum()), -1) if held.any() else np.zeros((0, 0))
            vectors.append((held, flat))
        if vectors:
            ids = np.concatenate(ids)
            by_id = np.argsort(ids, kind="stable")
            # null vectors are all NaN
            packed = np.full((len(ids), max(flat.shape[1] for _, flat in vectors)), np.nan)
            if packed.shape[1]:
                packed[np.concatenate([held for held, _ in vectors])] = np.concatenate([flat for _, flat in vectors if len(flat)])
            packed = packed[by_id]
            yield pa.RecordBatch.from_arrays([pa.array([ids[by_id].tobytes()]), pa.array([packed.tobytes()])], names=["ids", "e"])

    blocks = max(1, -(-vectors.count() // rows))
    return vectors.repartition(blocks, "vec_id").mapInArrow(run, "ids binary, e binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of (vec_id, embedding) by cosine, by id at equal scores.

    Every pair is scored, as products of a block of queries and one of
    vectors: a task holds two blocks and the scores of a few hundred queries,
    and gives each query's k best of its block. Null vectors have null scores.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vi, ve, qi, qe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, asking = np.frombuffer(vi, np.int64), np.frombuffer(qi, np.int64)
                v, q = (np.frombuffer(e).reshape(n, -1) if e else np.full((n, len(other) // 8 // m or 1), np.nan) for e, n, other, m in ((ve, len(ids), qe, len(asking)), (qe, len(asking), ve, len(ids))))
                vn, qn = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
                for at in range(0, len(asking), 256):
                    own = asking[at : at + 256]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = q[at : at + 256] @ v.T / (qn[at : at + 256, None] * vn)
                    # a null score comes last, -2 stands for it
                    s = np.nan_to_num(np.copysign(np.floor(np.abs(s) * 1e5 + 0.5), s) / 1e5 + 0.0, nan=-2.0)
                    same = own[:, None] == ids
                    s[same] = -np.inf
                    n = min(k, len(ids))
                    least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n, None]
                    above, equal = s > least, s == least
                    chosen = above | equal & (np.cumsum(equal, axis=1) <= n - above.sum(1, keepdims=True))
                    i, j = np.nonzero(chosen & ~same)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(s[i, j], mask=s[i, j] == -2)], names=["query_id", "vec_id", "score"])

    asking = _blocks(queries, ASKING).select(F.col("ids").alias("query_ids"), F.col("e").alias("q")).hint("shuffle_replicate_nl")
    pairs = _blocks(vectors, VECTORS).crossJoin(asking)
    return top(pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k, "query_id", "vec_id")


@query(
    f"""WITH {FILES_SQL}, s AS (SELECT file_id, string_split(text, chr(10)) AS l FROM files),
    c AS (SELECT file_id, l, unnest(range(0, greatest(len(l) - 10, 1), 30)) AS o FROM s)
    SELECT file_id, CAST(o + 1 AS BIGINT) AS first_line, CAST(least(o + 40, len(l)) AS BIGINT) AS last_line, sha256(array_to_string(list_slice(l, o + 1, o + 40), chr(10))) AS text_hash FROM c"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-CHUNK: windows of 40 lines that overlap by 10."""
    s = files(spark, sf_dir).select("file_id", F.split("text", "\n", -1).alias("l"))
    c = s.select("file_id", "l", F.explode(F.sequence(F.lit(0), F.greatest(F.size("l") - 11, F.lit(0)), F.lit(30))).alias("at"))
    return c.select("file_id", (F.col("at") + 1).cast("bigint").alias("first_line"), F.least(F.col("at") + 40, F.size("l")).cast("bigint").alias("last_line"), F.sha2(F.array_join(F.slice("l", F.col("at") + 1, 40), "\n"), 256).alias("text_hash"))


NEEDLES = ["tion", "password", "the", "ing", "license"]
_NEEDLE_SQL = "needles AS (SELECT unnest(['" + "','".join(NEEDLES) + "']) AS term)"


@query(
    rf"""WITH {FILES_SQL}, {LINES_SQL}, {_NEEDLE_SQL},
    w AS (SELECT file_id, line_no, strlen(line) AS size, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')) AS term FROM lines),
    tf AS (SELECT file_id, line_no, size, term, count(*) AS tf FROM w SEMI JOIN needles USING (term) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(strlen(line)) AS avg_size FROM lines), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT file_id, CAST(line_no AS BIGINT) AS line_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * size / avg_size))) * (1 + 0.5 * (count(*) - 1)), 4) AS score
    FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY file_id, line_no"""
)
def line_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-LINE: lines scored for a word list, length in bytes, more for several distinct words."""
    ls = lines(files(spark, sf_dir)).withColumn("size", F.octet_length("line"))
    w = ls.select("file_id", "line_no", "size", F.explode(tx.words(F.col("line"))).alias("term")).where(F.col("term").isin(NEEDLES))
    tf = w.groupBy("file_id", "line_no", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    st = ls.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_size"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.5 + 0.5 * F.col("size") / F.col("avg_size")))
    # df has one row a needle, st one row
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(st)).groupBy("file_id", "line_no").agg(F.round(F.sum(part) * (1 + 0.5 * (F.count(F.lit(1)) - 1)), 4).alias("score"))


@query(
    rf"""WITH q AS (SELECT unnest(['tion', 'erin', 'pass', 'onth']) AS q), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents)
    SELECT q, term, CASE WHEN q = term THEN 1.0 WHEN starts_with(term, q) OR (starts_with(q, term) AND length(term) >= 4) THEN 0.6 ELSE 0.5 END::DOUBLE AS weight
    FROM q JOIN w ON q = term OR starts_with(term, q) OR (starts_with(q, term) AND length(term) >= 4) OR (abs(length(q) - length(term)) <= 1 AND length(term) >= 4 AND levenshtein(q, term) <= 1)"""
)
def fuzzy_vocab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-FUZZY: equal 1.0, prefix either way 0.6, one edit 0.5, on the distinct vocabulary."""
    vocab = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))).alias("term")).distinct()
    return fuzzy(spark.createDataFrame([(x,) for x in ("tion", "erin", "pass", "onth")], "q string"), vocab)


def fuzzy(q: DataFrame, vocab: DataFrame) -> DataFrame:
    """Question terms (a stated, small set) against a vocabulary."""
    term, qq = F.col("term"), F.col("q")
    prefix = F.startswith(term, qq) | (F.startswith(qq, term) & (F.char_length(term) >= 4))
    near = (F.abs(F.char_length(qq) - F.char_length(term)) <= 1) & (F.char_length(term) >= 4) & (F.levenshtein(qq, term, 1) >= 0)
    joined = vocab.join(F.broadcast(q), (qq == term) | prefix | near)
    return joined.select("q", "term", F.when(qq == term, 1.0).when(prefix, 0.6).otherwise(0.5).cast("double").alias("weight"))


@query(
    rf"""WITH {FILES_SQL}, b AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM files UNION ALL SELECT unnest(regexp_extract_all(lower(path), '[\p{{L}}\p{{N}}]+')) FROM files)
    SELECT term, CAST(count(*) AS BIGINT) AS n, count(*) < 40 AS rare FROM b GROUP BY term"""
)
def df_exact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-DFEXACT: postings of each term over names and bodies; rare below 40."""
    f = files(spark, sf_dir)
    terms = f.select(F.explode(F.concat(tx.words(F.col("text")), tx.words(F.col("path")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("rare", F.col("n") < 40)


#: Fielded search: weights of name, body and their constants.
FIELDED = {"k1": 1.4, "b": 0.75, "name": 1.0, "body": 0.5, "coverage": 2.0, "path": 0.3, "test": 0.8}
_QSQL = r"q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark), nq AS (SELECT item_id, count(*) AS terms FROM q GROUP BY item_id)"
_FSQL = rf"""WITH {FILES_SQL}, {_QSQL},
 hd AS (SELECT file_id, path, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{{L}}\p{{N}}]+') AS name, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS body FROM files),
 st AS (SELECT count(*) AS n, greatest(avg(len(name)), 1) AS an, greatest(avg(len(body)), 1) AS ab FROM hd),
 nt AS (SELECT file_id, len(name) AS l, unnest(name) AS term FROM hd), np AS (SELECT file_id, l, term, count(*) AS tf FROM nt SEMI JOIN q USING (term) GROUP BY ALL),
 bt AS (SELECT file_id, len(body) AS l, unnest(body) AS term FROM hd), bp AS (SELECT file_id, l, term, count(*) AS tf FROM bt SEMI JOIN q USING (term) GROUP BY ALL),
 nd AS (SELECT term, count(*) AS df, greatest(0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM np CROSS JOIN st GROUP BY term),
 bd AS (SELECT term, greatest(0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM bp CROSS JOIN st GROUP BY term),
 parts AS (SELECT item_id, file_id, 1.0 * idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * l / an)) AS s, term AS seen FROM q JOIN np USING (term) JOIN nd USING (term) CROSS JOIN st
  UNION ALL SELECT item_id, file_id, 0.5 * idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * l / ab)), NULL FROM q JOIN bp USING (term) JOIN bd USING (term) CROSS JOIN st),
 tot AS (SELECT item_id, sum(idf) AS total FROM q JOIN nd USING (term) GROUP BY item_id),
 cov AS (SELECT item_id, file_id, sum(idf) AS covered FROM (SELECT DISTINCT item_id, file_id, seen AS term FROM parts WHERE seen IS NOT NULL) JOIN nd USING (term) GROUP BY ALL),
 sc AS (SELECT item_id, file_id, sum(s) AS s FROM parts GROUP BY ALL)"""


def _fielded(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """Files worded by the fields named (name: the first line, body), and the questions' terms."""
    fields = {"name": tx.words(F.split("text", "\n")[0]), "body": tx.words(F.col("text"))}
    return worded(files(spark, sf_dir), "file_id", **{x: fields[x] for x in names}), question_terms(table(spark, sf_dir, "benchmark"))


@query(
    _FSQL
    + """ SELECT item_id, file_id, round(s * (1 + 2.0 * coalesce(covered, 0) / coalesce(total, 1)), 4) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s * (1 + 2.0 * coalesce(covered, 0) / coalesce(total, 1)), 4) DESC, file_id) AS INTEGER) AS rank
    FROM sc LEFT JOIN cov USING (item_id, file_id) LEFT JOIN tot USING (item_id) QUALIFY rank <= 10"""
)
def bm25f_names_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-BM25F: names (first lines) and bodies with their own idf and lengths, times coverage."""
    f, q = _fielded(spark, sf_dir, "name", "body")

    def made(asked: Asked) -> DataFrame:
        st = stats(f, asked)
        weights, means = [idf(st, x) for x in (0, 1)], [max(w / max(1, st.n), 1) for w in st.words]
        total = asked.total(np.where(st.df[0] > 0, weights[0], 0))
        total[total == 0] = 1  # no file has a word of the question in its name

        def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray]:
            parts = [w * rare[h.t] * h.tf * 2.4 / (h.tf + 1.4 * (0.25 + 0.75 * h.length[h.d] / mean)) for h, w, rare, mean in zip(held, (1.0, 0.5), weights, means, strict=True)]
            s = sum(asked.cells(h.d, h.t, n, part) for h, part in zip(held, parts, strict=True))
            hit = sum(asked.cells(h.d, h.t, n) for h in held) > 0
            covered = asked.cells(held[0].d, held[0].t, n, weights[0][held[0].t])
            return hit, rounded(s * (1 + 2.0 * covered / total), 4)

        return scored(f, asked, score, ["score"], 10)

    return top(each_block(q, made).withColumnRenamed("doc_id", "file_id"), 10, "item_id", "file_id")


@query(_FSQL + " SELECT item_id, file_id, round(1 + 2.0 * covered / total, 6) AS multiplier FROM cov JOIN tot USING (item_id)")
def coverage_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 6: 1 + 2 * idf-weighted share of the question's terms in a file's identity."""
    f, q = _fielded(spark, sf_dir, "name")

    def made(asked: Asked) -> DataFrame:
        st = stats(f, asked)
        weight = idf(st)
        total = asked.total(np.where(st.df[0] > 0, weight, 0))

        def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray]:
            (h,) = held
            with np.errstate(invalid="ignore", divide="ignore"):  # questions without any word of a name have no hits
                return asked.cells(h.d, h.t, n) > 0, rounded(1 + 2.0 * asked.cells(h.d, h.t, n, weight[h.t]) / total, 6)

        return scored(f, asked, score, ["multiplier"])

    return each_block(q, made).withColumnRenamed("doc_id", "file_id")


@query(
    rf"""WITH {FILES_SQL}, q AS (SELECT unnest(['en', 'src3', 'txt', 'doc', 'fr']) AS term), n AS (SELECT count(*) AS n FROM files),
    p AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(path), '[a-z]+[0-9]*')) AS term FROM files), h AS (SELECT * FROM p SEMI JOIN q USING (term)),
    d AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM h CROSS JOIN n GROUP BY term)
    SELECT file_id, round(0.3 * sum(greatest(idf, 0)), 6) AS bonus FROM h JOIN d USING (term) GROUP BY file_id"""
)
def path_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-PATH: 0.3 * idf of question terms in the path."""
    f = files(spark, sf_dir)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    h = f.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+[0-9]*)"), F.lit(1)))).alias("term")).where(F.col("term").isin("en", "src3", "txt", "doc", "fr"))
    d = h.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf"))
    return h.join(F.broadcast(d), "term").groupBy("file_id").agg(F.round(0.3 * F.sum("idf"), 6).alias("bonus"))


RULES = [("src1%", 1.5), ("%/fr/%", 0.5), ("%_7.txt", 5.0), ("src2/%", 0.05)]


@query(
    f"""WITH {FILES_SQL}, r AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {m})" for p, m in RULES)}) AS t(p, m))
    SELECT file_id, round(coalesce(product(CASE WHEN m IS NULL THEN 1 ELSE least(2.0, greatest(0.1, m)) END), 1), 6) AS multiplier FROM files LEFT JOIN r ON path LIKE p GROUP BY file_id"""
)
def profile_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-PROFILE: product of the matching path rules, each clamped to 0.1-2."""
    out = F.lit(1.0)
    for pattern, m in RULES:
        # the escape keeps "_" the wildcard it is in the rules
        out = out * F.when(F.col("path").like(pattern), min(2.0, max(0.1, m))).otherwise(1.0)
    return files(spark, sf_dir).select("file_id", F.round(out, 6).alias("multiplier"))


@query(
    r"""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
    p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS prose FROM pages),
    f AS (SELECT page_id, 3.0 AS w, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term FROM p UNION ALL SELECT page_id, 1.0, unnest(regexp_extract_all(lower(prose), '[\p{L}\p{N}]+')) FROM p),
    l AS (SELECT page_id, sum(w) AS l FROM f GROUP BY page_id), st AS (SELECT count(*) AS n, avg(l) AS al FROM l),
    tf AS (SELECT page_id, term, sum(w) AS tf FROM f SEMI JOIN q USING (term) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT item_id, page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * l / al))), 4) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN l USING (page_id) CROSS JOIN st GROUP BY ALL)
    SELECT item_id, page_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
)
def web_bm25f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-WEB: titles at three times the weight of prose, k1 = 1.2, b = 0.5."""
    q = question_terms(table(spark, sf_dir, "benchmark"))
    p = worded(table(spark, sf_dir, "pages"), "page_id", title=tx.words(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), prose=tx.words(F.regexp_replace("html", "<[^>]*>", " ")))
    p = p.where("l_title + l_prose > 0")
    # a page holds a word in either field: the field of both has the numbers of pages
    both = p.select("id", "rows", *[F.lit(0).cast("bigint").alias(x) for x in ("l", "total")], F.concat("w_title", "w_prose").alias("w"))

    def made(asked: Asked) -> DataFrame:
        size, st = stats(p, asked), stats(both, asked)
        weight, mean = idf(st), (3.0 * size.words[0] + size.words[1]) / max(1, size.n)

        def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray]:
            title, prose = held
            key, at = np.unique(np.concatenate([h.d * len(asked.words) + h.t for h in held]), return_inverse=True)
            d, t = np.divmod(key, max(1, len(asked.words)))
            tf = np.bincount(at, np.concatenate([3.0 * title.tf, prose.tf]), len(key))
            length = 3.0 * title.length + prose.length
            part = weight[t] * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * length[d] / mean))
            return asked.cells(d, t, n) > 0, rounded(asked.cells(d, t, n, part), 4)

        return scored(p, asked, score, ["score"], 5)

    return top(each_block(q, made).withColumnRenamed("doc_id", "page_id"), 5, "item_id", "page_id")


@query(
    f"""WITH {QUESTIONS_SQL}, {BODY_SQL}, i AS (SELECT term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT term FROM qt) LEFT JOIN df USING (term) CROSS JOIN stat),
    c AS (SELECT item_id, doc_id, sum(idf) AS covered FROM qt JOIN post USING (term) JOIN i USING (term) GROUP BY ALL), t AS (SELECT item_id, sum(idf) AS total FROM qt JOIN i USING (term) GROUP BY item_id)
    SELECT item_id, round(coalesce(max(covered), 0) / any_value(total), 6) AS confidence, coalesce(max(covered), 0) / any_value(total) < 0.33 AS abstain FROM t LEFT JOIN c USING (item_id) GROUP BY item_id"""
)
def confidence_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-CONF: best idf-weighted coverage of a question; below 0.33 there is no answer."""
    body = bodies(table(spark, sf_dir, "documents"))

    def made(asked: Asked) -> DataFrame:
        weight = idf(stats(body, asked))
        total = spark.createDataFrame(pa.table({"item_id": asked.items, "total": asked.total(weight)}))

        def score(held: list[Held], n: int) -> tuple[np.ndarray, np.ndarray]:
            (h,) = held
            return asked.cells(h.d, h.t, n) > 0, asked.cells(h.d, h.t, n, weight[h.t])

        best = scored(body, asked, score, ["c"], 1).groupBy("item_id").agg(F.max("c").alias("c"))
        return total.join(best, "item_id", "left")

    share = F.coalesce("c", F.lit(0.0)) / F.col("total")
    return each_block(question_terms(table(spark, sf_dir, "benchmark")), made).select("item_id", F.round(share, 6).alias("confidence"), (share < 0.33).alias("abstain"))
