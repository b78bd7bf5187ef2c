"""Budgeted selection, co-change, test selection, evaluation and metrics.

Commits are orders, files are parts: an order's lines are the files that
changed together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.retrieval import EXPECTED_SQL, SCORES_SQL, bm25, expected, question_terms, top
from lorekeep.plans.registry import query
from lorekeep.sources.tables import table


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem), n AS (SELECT commit_id, count(*) AS n FROM c GROUP BY commit_id HAVING count(*) <= 30)
    SELECT a.file AS file_a, b.file AS file_b, round(sum(1 / sqrt(n)), 6) AS weight FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.file < b.file JOIN n ON n.commit_id = a.commit_id GROUP BY ALL HAVING count(*) >= 2"""
)
def cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-COCHANGE: pairs that changed together in commits of at most 30 files, weighted 1/sqrt(files)."""
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey commit_id", "l_partkey file").groupBy("commit_id").agg(F.sort_array(F.collect_set("file")).alias("f")).where(F.size("f") <= 30)
    w = 1 / F.sqrt(F.size("f"))
    # each commit expands by itself: no self-join and no second shuffle by commit
    pairs = c.select(w.alias("w"), F.posexplode("f").alias("i", "file_a"), "f").select("w", "file_a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.round(F.sum("w"), 6).alias("weight"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query(
    """WITH recent AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 600), n AS (SELECT l_partkey AS file, count(*) AS n FROM lineitem SEMI JOIN recent ON o_orderkey = l_orderkey GROUP BY file)
    SELECT file, round(ln(1 + n) / ln(1 + max(n) OVER ()), 6) AS hot FROM n"""
)
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-HOT: how often a file changed in the last 600 commits, on a log scale."""
    recent = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(600).select(F.col("o_orderkey").alias("l_orderkey"))
    # 600 keys
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(F.broadcast(recent), "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    top_n = n.agg(F.max("n").alias("m"))
    return n.crossJoin(F.broadcast(top_n)).select("file", F.round(F.log(1 + F.col("n")) / F.log(1 + F.col("m")), 6).alias("hot"))


TEST_WEIGHTS = {0: 6.0, 1: 4.0, 2: 1.5, 3: 0.5}
HUB = 120


@query(
    f"""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), deg AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
    d1 AS (SELECT DISTINCT src FROM e WHERE dst IN (SELECT p_partkey FROM part WHERE p_partkey % 97 = 0)), d2n AS (SELECT DISTINCT dst FROM e JOIN d1 USING (src) JOIN deg USING (dst) WHERE n <= {HUB}),
    d2 AS (SELECT DISTINCT src FROM e JOIN d2n USING (dst) ANTI JOIN d1 USING (src)), i AS (SELECT src, count(*) AS imports FROM e GROUP BY src)
    SELECT src AS test, round(w / (1 + 0.15 * imports), 6) AS score FROM (SELECT src, 4.0 AS w FROM d1 UNION ALL SELECT src, 1.5 FROM d2) JOIN i USING (src)"""
)
def test_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-TESTSEL: tests by distance to the changed files, less for those that import much; no walk through hubs."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey src", "l_partkey dst").distinct()
    changed = table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("dst"))
    d1 = e.join(changed, "dst", "left_semi").select("src").distinct()
    quiet = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= HUB)
    near = e.join(d1, "src", "left_semi").join(quiet, "dst", "left_semi").select("dst").distinct()
    d2 = e.join(near, "dst", "left_semi").select("src").distinct().join(d1, "src", "left_anti")
    imports = e.groupBy("src").agg(F.count(F.lit(1)).alias("imports"))
    both = d1.withColumn("w", F.lit(4.0)).unionByName(d2.withColumn("w", F.lit(1.5)))
    return both.join(imports, "src").select(F.col("src").alias("test"), F.round(F.col("w") / (1 + 0.15 * F.col("imports")), 6).alias("score"))


@query(
    """WITH c AS (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS cost FROM conversations), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c),
    f AS (SELECT *, count(*) FILTER (used > 300 AND k > 1) OVER (PARTITION BY conv_id ORDER BY turn) AS refused FROM s) SELECT conv_id, turn, cost, CAST(used AS BIGINT) AS used FROM f WHERE refused = 0"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-OUT: lines until the first that does not fit; the first always does."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4).cast("bigint").alias("cost"))
    s = c.withColumn("used", F.sum("cost").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    return s.withColumn("refused", F.max(((F.col("used") > 300) & (F.col("k") > 1)).cast("int")).over(w)).where("refused = 0").select("conv_id", "turn", "cost", "used")


EVIDENCE = [("F", 100), ("O", 80), ("P", 60)]


@query(
    """WITH e AS (SELECT o_custkey AS symbol, 'status ' || o_orderstatus AS reason, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 80 ELSE 60 END AS w FROM orders UNION ALL SELECT o_custkey, 'priority', 75 FROM orders WHERE starts_with(o_orderpriority, '1')),
    d AS (SELECT symbol, reason, max(w) AS w FROM e GROUP BY ALL) SELECT symbol, CAST(sum(w) - CASE WHEN symbol % 10 = 0 THEN 50 ELSE 0 END AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS reasons FROM d GROUP BY symbol"""
)
def ui_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-UI: evidence by symbol, each distinct reason once, archived symbols less 50."""
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("symbol"), F.concat(F.lit("status "), "o_orderstatus").alias("reason"), F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 80).otherwise(60).alias("w"))
    b = o.where(F.startswith("o_orderpriority", F.lit("1"))).select(F.col("o_custkey").alias("symbol"), F.lit("priority").alias("reason"), F.lit(75).alias("w"))
    d = a.unionByName(b).groupBy("symbol", "reason").agg(F.max("w").alias("w"))
    return d.groupBy("symbol").agg((F.sum("w") - F.when(F.col("symbol") % 10 == 0, 50).otherwise(0)).cast("bigint").alias("score"), F.count(F.lit(1)).alias("reasons"))


#: Decay a fact of its seed and kind, of bare names, and of its file for definitions and callees.
DECAY, BARE_DECAY, FILE_DECAY = 0.85, 0.97, 0.75
BUDGET = 90


def greedy_order(facts: list[tuple], budget: int) -> list[tuple[int, float]]:
    """(fact, ratio) in the order taken, of facts (seed, kind, file, value, cost).

    Each step takes the fact of most value for its cost that still fits, its
    value decayed by the facts taken of its seed and kind and, for definitions
    and callees, of its file and kind. Facts other than definitions and bare
    names wait until a fact of their seed is taken. The first wins ties.
    """
    left, by_seed, by_file, opened, taken = list(range(len(facts))), {}, {}, set(), []
    while left:
        best, best_ratio = None, 0.0
        for i in left:
            seed, kind, file, value, cost = facts[i]
            if cost > budget or kind not in ("def", "bare") and seed not in opened:
                continue
            decay = (BARE_DECAY if kind == "bare" else DECAY) ** by_seed.get((seed, kind), 0)
            if kind in ("def", "callee"):
                decay *= FILE_DECAY ** by_file.get((file, kind), 0)
            ratio = value * decay / max(1, cost)
            if best is None or ratio > best_ratio:
                best, best_ratio = i, ratio
        if best is None:
            break
        seed, kind, file, _, cost = facts[best]
        left.remove(best)
        budget -= cost
        opened.add(seed)
        by_seed[seed, kind] = by_seed.get((seed, kind), 0) + 1
        by_file[file, kind] = by_file.get((file, kind), 0) + 1
        taken.append((best, best_ratio))
    return taken


def take_greedy(facts: pd.DataFrame, budget: int) -> pd.DataFrame:
    """greedy_order of a question's facts as a table."""
    rows = list(facts[["seed", "kind", "file", "value", "cost"]].itertuples(index=False, name=None))
    taken = greedy_order(rows, budget)
    out = facts.iloc[[i for i, _ in taken]][["q_id", "fact", "cost"]].reset_index(drop=True)
    return out.assign(pos=range(1, len(taken) + 1), ratio=[round(r, 6) for _, r in taken])[["q_id", "pos", "fact", "cost", "ratio"]]


def _greedy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by question, in order -> what is taken; memory holds a question's facts."""
    question, facts, out = None, [], []

    def done():
        out.extend((question, k, i + 1, facts[i][4], round(ratio, 6)) for k, (i, ratio) in enumerate(greedy_order(facts, BUDGET), 1))

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["q_id", "pos", "fact", "cost", "ratio"])

    for part in batches:
        for q, *fact in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if q != question:
                done()
                question, facts = q, []
            facts.append(tuple(fact))
        yield batch()
        out.clear()
    done()
    yield batch()


_FACTS_SQL = """f AS (SELECT l_orderkey AS q_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS fact, l_suppkey % 3 AS seed,
    CASE WHEN l_suppkey % 5 = 0 THEN 'bare' WHEN l_returnflag = 'A' THEN 'def' WHEN l_returnflag = 'N' THEN 'callee' ELSE 'caller' END AS kind, l_partkey AS file, CAST(l_extendedprice AS DOUBLE) AS value, CAST(10 + floor(l_quantity) AS INTEGER) AS cost FROM lineitem)"""


@query(
    f"""WITH RECURSIVE {_FACTS_SQL},
    g AS (SELECT DISTINCT q_id, CAST(0 AS BIGINT) AS pos, CAST({BUDGET} AS BIGINT) AS room, CAST([] AS STRUCT(fact BIGINT, seed BIGINT, kind VARCHAR, file BIGINT)[]) AS took, CAST(NULL AS BIGINT) AS fact, CAST(NULL AS INTEGER) AS cost, CAST(NULL AS DOUBLE) AS ratio FROM f
      UNION ALL SELECT q_id, pos + 1, room - x.cost, list_append(took, {{'fact': x.fact, 'seed': x.seed, 'kind': x.kind, 'file': x.file}}), x.fact, x.cost, x.gain FROM (
        SELECT g.q_id, g.pos, g.room, g.took, f.fact, f.seed, f.kind, f.file, f.cost,
          f.value * pow(CASE WHEN f.kind = 'bare' THEN {BARE_DECAY} ELSE {DECAY} END, len(list_filter(g.took, lambda t: t.seed = f.seed AND t.kind = f.kind)))
          * pow({FILE_DECAY}, CASE WHEN f.kind IN ('def', 'callee') THEN len(list_filter(g.took, lambda t: t.file = f.file AND t.kind = f.kind)) ELSE 0 END) / greatest(1, f.cost) AS gain
        FROM g JOIN f ON f.q_id = g.q_id WHERE f.cost <= g.room AND len(list_filter(g.took, lambda t: t.fact = f.fact)) = 0 AND (f.kind IN ('def', 'bare') OR len(list_filter(g.took, lambda t: t.seed = f.seed)) > 0)
        QUALIFY row_number() OVER (PARTITION BY g.q_id ORDER BY gain DESC, f.fact) = 1) x)
    SELECT q_id, pos, fact, cost, round(ratio, 6) AS ratio FROM g WHERE pos > 0"""
)
def greedy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-GREEDY: order-dependent choice of facts under a token budget, by question.

    A question's candidate facts are bounded by its report (here an order's
    lines): rows stream by question through their task.
    """
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_suppkey") % 5 == 0, "bare").when(F.col("l_returnflag") == "A", "def").when(F.col("l_returnflag") == "N", "callee").otherwise("caller")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"]
    facts = li.select("l_orderkey", *order, kind.alias("kind")).repartition("l_orderkey").sortWithinPartitions("l_orderkey", *order)
    rows = facts.selectExpr("l_orderkey", "l_suppkey % 3", "kind", "l_partkey", "cast(l_extendedprice as double)", "cast(10 + l_quantity as int)")
    return rows.mapInArrow(_greedy, "q_id bigint, pos bigint, fact bigint, cost int, ratio double")


@query(
    f"""WITH {SCORES_SQL}, {EXPECTED_SQL}, hit AS (SELECT item_id, min(rank) AS rank FROM expected JOIN ranked USING (item_id, doc_id) WHERE rank <= 20 GROUP BY item_id)
    SELECT CAST(count(*) AS BIGINT) AS found, CAST(quantile_disc(rank, 0.95) AS BIGINT) AS p95_rank, median(rank) AS median_rank FROM hit"""
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-PCT: nearest-rank percentile and median of the first expected ranks."""
    docs, bm = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hit = expected(docs, bm).join(top(bm25(docs, question_terms(bm), best=20), 20), ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("rank"))
    return hit.agg(F.count(F.lit(1)).alias("found"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY rank)").cast("bigint").alias("p95_rank"), F.median("rank").alias("median_rank"))


@query(
    f"""WITH {SCORES_SQL}, {EXPECTED_SQL}, k AS (SELECT unnest([1, 5, 10, 20]) AS k), e AS (SELECT item_id, count(*) AS n FROM expected GROUP BY item_id)
    SELECT CAST(k AS INTEGER) AS k, round(avg(coalesce(h, 0) / n), 6) AS recall FROM k CROSS JOIN e LEFT JOIN (SELECT k, item_id, count(*)::DOUBLE AS h FROM k JOIN ranked ON rank <= k SEMI JOIN expected USING (item_id, doc_id) GROUP BY ALL) USING (k, item_id) GROUP BY k"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-RECALL: share of the expected documents within the first k, mean over questions."""
    docs, bm = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = expected(docs, bm)
    ranks = want.join(top(bm25(docs, question_terms(bm), best=20), 20), ["item_id", "doc_id"], "left")
    ks = (1, 5, 10, 20)
    per = ranks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias(f"h{k}") for k in ks])
    means = per.agg(*[F.round(F.avg(F.col(f"h{k}") / F.col("n")), 6).alias(f"r{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])).alias("x")).select("x.k", "x.recall")


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT item_id, doc_id, rank, sum(ceil(n_chars / 40.0)) OVER (PARTITION BY item_id ORDER BY rank) AS tokens FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20), {EXPECTED_SQL}
    SELECT item_id, CAST(min(tokens) AS BIGINT) AS tokens_to_first FROM r SEMI JOIN expected USING (item_id, doc_id) GROUP BY item_id"""
)
def tokens_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-TOK: tokens read before the first expected document is reached."""
    docs, bm = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = top(bm25(docs, question_terms(bm), best=20), 20).join(docs.select("doc_id", "n_chars"), "doc_id")
    used = ranked.withColumn("tokens", F.sum(F.ceil(F.col("n_chars") / 40)).over(Window.partitionBy("item_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)))
    return used.join(expected(docs, bm), ["item_id", "doc_id"], "left_semi").groupBy("item_id").agg(F.min("tokens").cast("bigint").alias("tokens_to_first"))


@query(
    """SELECT event_type, CAST(count(*) AS BIGINT) AS calls, round(median(value), 6) AS median_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type"""
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-LATENCY: median and 95th percentile by stage."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.median("value"), 6).alias("median_ms"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95_ms"))


@query(
    """WITH l AS (SELECT o_custkey AS q, o_orderkey % 40 AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders), f AS (SELECT q, file, min(rank) AS rank FROM l GROUP BY ALL)
    SELECT q, file, CAST(row_number() OVER (PARTITION BY q ORDER BY rank) AS INTEGER) AS pos FROM f QUALIFY pos <= 5"""
)
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-DISTINCT: the first five distinct files of a ranked list."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey q", "o_orderkey % 40 file", "o_orderkey ord")
    f = o.groupBy("q", "file").agg(F.min("ord").alias("first"))
    return f.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("first"))).where("pos <= 5").select("q", "file", "pos")


INTENTS = [("what breaks if I change X", "impact"), ("path from a to b", "path"), ("overview of module auth", "module"), ("how does login work", "explain"), ("where is the parser", "locate")]


@query(
    "WITH q AS (SELECT unnest(['" + "','".join(q for q, _ in INTENTS) + "']) AS q) SELECT q, CASE WHEN regexp_matches(q, 'break|impact|affect') THEN 'impact' WHEN regexp_matches(q, 'path|from .* to ') THEN 'path' WHEN regexp_matches(q, 'overview|module|structure') THEN 'module' WHEN regexp_matches(q, '^(how|why|explain)') THEN 'explain' ELSE 'locate' END AS intent FROM q"
)
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-INTENT: kind of question by rules in order."""
    q = F.col("q")
    intent = F.when(q.rlike("break|impact|affect"), "impact").when(q.rlike("path|from .* to "), "path").when(q.rlike("overview|module|structure"), "module").when(q.rlike("^(how|why|explain)"), "explain").otherwise("locate")
    return spark.createDataFrame([(x,) for x, _ in INTENTS], "q string").select("q", intent.alias("intent"))


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem), n AS (SELECT commit_id, count(*) AS n FROM c GROUP BY commit_id), seed AS (SELECT commit_id FROM c WHERE file <= 20),
    co AS (SELECT file, sum(1 / sqrt(n)) AS w FROM c JOIN n USING (commit_id) SEMI JOIN seed USING (commit_id) GROUP BY file), t AS (SELECT p_partkey AS file, 1.0 / (1 + p_size) AS s FROM part), m AS (SELECT max(w) AS m FROM co)
    SELECT file, round(s + 0.6 * coalesce(w, 0) / m, 6) AS score FROM t LEFT JOIN co USING (file) CROSS JOIN m ORDER BY score DESC, file LIMIT 40"""
)
def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-PACK: files by text score plus 0.6 of the normalised co-change with the seeds; best 40."""
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey commit_id", "l_partkey file").groupBy("commit_id").agg(F.collect_set("file").alias("f"))
    co = c.where(F.exists("f", lambda x: x <= 20)).select((1 / F.sqrt(F.size("f"))).alias("x"), F.explode("f").alias("file")).groupBy("file").agg(F.sum("x").alias("w"))
    t = table(spark, sf_dir, "part").selectExpr("p_partkey file", "1.0D / (1 + p_size) s")
    scored = t.join(co, "file", "left").crossJoin(F.broadcast(co.agg(F.max("w").alias("m"))))
    return scored.select("file", F.round(F.col("s") + 0.6 * F.coalesce("w", F.lit(0.0)) / F.col("m"), 6).alias("score")).orderBy(F.desc("score"), "file").limit(40)
