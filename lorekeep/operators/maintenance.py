"""Incremental index maintenance: segments, merged views, change detection, deltas.

Segments of the test data: orders written in three passes (segment = order
key mod 3); later segments override and delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

SEG_SQL = "seg AS (SELECT o_orderkey % 500 AS id, o_orderkey % 7 AS segment, o_orderkey AS version, o_totalprice AS value, o_orderkey % 11 = 0 AS tombstone FROM orders)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey % 500 id", "o_orderkey % 7 segment", "o_orderkey version", "o_totalprice value", "o_orderkey % 11 = 0 tombstone")


def merged(seg: DataFrame) -> DataFrame:
    """The current version of each id: newest segment wins, tombstones kill.

    max_by combines map-side, so an id with very many versions is one row a task.
    """
    newest = seg.groupBy("id").agg(F.max_by(F.struct("segment", "version", "value", "tombstone"), F.struct("segment", "version")).alias("x"))
    return newest.select("id", "x.*").where("NOT tombstone").drop("tombstone")


@query(f"WITH {SEG_SQL} SELECT id, segment, version, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment DESC, version DESC) AS r FROM seg) WHERE r = 1 AND NOT tombstone")
def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX-VIEW: merged current version of a segmented table."""
    return merged(segments(spark, sf_dir))


_CHG_SQL = "known AS (SELECT c_custkey AS path, c_nationkey AS size, round(c_acctbal) AS hash FROM customer WHERE c_custkey % 10 <> 0), now AS (SELECT c_custkey AS path, c_nationkey + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS size, round(c_acctbal) + CASE WHEN c_custkey % 26 = 0 THEN 1 ELSE 0 END AS hash FROM customer WHERE c_custkey % 9 <> 0)"


@query(
    f"""WITH {_CHG_SQL} SELECT coalesce(known.path, now.path) AS path, CASE WHEN known.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' WHEN known.hash <> now.hash THEN 'modified' WHEN known.size <> now.size THEN 'touched' ELSE 'same' END AS state FROM known FULL JOIN now ON known.path = now.path"""
)
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-DIFF, SRC-HASHDIFF and IDX-CLASSIFY: added, removed, modified, touched, same."""
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 10 <> 0").selectExpr("c_custkey path", "c_nationkey s0", "round(c_acctbal) h0", "true k")
    now = c.where("c_custkey % 9 <> 0").selectExpr("c_custkey path", "c_nationkey + if(c_custkey % 13 = 0, 1, 0) s1", "round(c_acctbal) + if(c_custkey % 26 = 0, 1, 0) h1", "true n")
    state = F.when(F.col("k").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified").when(F.col("s0") != F.col("s1"), "touched").otherwise("same")
    return known.join(now, "path", "full").select("path", state.alias("state"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderstatus AS name, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS new_id, o_custkey AS file, o_orderstatus AS name, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT o.id, n.new_id FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name AND o.kind = n.kind AND o.nth = n.nth"""
)
def symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX-MATCH: symbols keep their id by (name, kind, nth occurrence)."""
    key = ["file", "name", "kind", "nth"]
    nth = F.row_number().over(Window.partitionBy("file", "name", "kind").orderBy("ord"))
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey ord", "o_custkey file", "o_orderstatus name", "o_orderpriority kind")
    old = s.where("ord % 3 <> 0").withColumn("nth", nth).withColumnRenamed("ord", "id")
    new = s.where("ord % 4 <> 0").withColumn("nth", nth).withColumnRenamed("ord", "new_id")
    return old.join(new, key, "full").select("id", "new_id")


@query(
    f"""WITH {SEG_SQL}, v AS (SELECT *, lag(value) OVER (PARTITION BY id ORDER BY segment, version) AS was, lag(tombstone) OVER (PARTITION BY id ORDER BY segment, version) AS dead FROM seg)
    SELECT segment, CAST(sum(CASE WHEN tombstone THEN 0 ELSE 1 END - CASE WHEN was IS NULL OR dead THEN 0 ELSE 1 END) AS BIGINT) AS docs, round(sum(CASE WHEN tombstone THEN 0 ELSE value END - CASE WHEN was IS NULL OR dead THEN 0 ELSE was END), 2) AS length FROM v GROUP BY segment"""
)
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX-DELTA: signed net contribution of each segment to the corpus statistics."""
    w = Window.partitionBy("id").orderBy("segment", "version")
    v = segments(spark, sf_dir).withColumn("was", F.lag("value").over(w)).withColumn("dead", F.lag("tombstone").over(w))
    gone = F.col("was").isNull() | F.col("dead")
    return v.groupBy("segment").agg(F.sum(F.when(F.col("tombstone"), 0).otherwise(1) - F.when(gone, 0).otherwise(1)).cast("bigint").alias("docs"), F.round(F.sum(F.when(F.col("tombstone"), 0.0).otherwise(F.col("value")) - F.when(gone, 0.0).otherwise(F.col("was"))), 2).alias("length"))


@query(
    f"""WITH {SEG_SQL}, s AS (SELECT count(DISTINCT segment) AS segments, count(*) FILTER (segment > 0) AS deltas, count(*) AS total FROM seg)
    SELECT CAST(segments AS BIGINT) AS segments, CASE WHEN deltas > 0.2 * total AND total > 1000 THEN 'rewrite trunk' WHEN segments > 16 THEN 'merge deltas' ELSE 'keep' END AS action FROM s"""
)
def compaction_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX-MERGE and IDX-COMPACT: what to do with the deltas."""
    s = segments(spark, sf_dir).agg(F.count_distinct("segment").alias("segments"), F.count_if(F.col("segment") > 0).alias("deltas"), F.count(F.lit(1)).alias("total"))
    return s.select("segments", F.when((F.col("deltas") > 0.2 * F.col("total")) & (F.col("total") > 1000), "rewrite trunk").when(F.col("segments") > 16, "merge deltas").otherwise("keep").alias("action"))


@query(
    f"""WITH changed AS (SELECT DISTINCT 'f' || (c_custkey % 97) AS name FROM customer WHERE c_custkey % 17 = 0), calls AS (SELECT o_orderkey AS file, 'f' || (o_custkey % 131) AS name FROM orders)
    SELECT DISTINCT file FROM calls SEMI JOIN changed USING (name)"""
)
def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX-AFFECTED: files that call a changed name."""
    changed = table(spark, sf_dir, "customer").where("c_custkey % 17 = 0").select(F.concat(F.lit("f"), (F.col("c_custkey") % 97).cast("string")).alias("name")).distinct()
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("f"), (F.col("o_custkey") % 131).cast("string")).alias("name"))
    return calls.join(changed, "name", "left_semi").select("file").distinct()


@query(
    """WITH p AS (SELECT o_custkey AS page, o_orderkey AS g, o_shippriority_n AS declared FROM (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 3 AS o_shippriority_n FROM orders)), s AS (SELECT l_orderkey AS g, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY g DESC) AS r FROM p) SELECT page, l.g, CAST(n AS BIGINT) AS sections FROM l JOIN s ON s.g = l.g WHERE r = 1 AND n >= declared"""
)
def store_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-STORE: last generation of each page, dropped when sections are missing."""
    p = table(spark, sf_dir, "orders").selectExpr("o_custkey page", "o_orderkey g", "1 + o_orderkey % 3 declared")
    last = p.groupBy("page").agg(F.max_by(F.struct("g", "declared"), "g").alias("x")).select("page", "x.*")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.count(F.lit(1)).alias("sections"))
    return last.join(n, "g").where("sections >= declared").select("page", "g", "sections")


@query(
    """WITH e AS (SELECT user_id % 50 AS mission, event_type AS tool, user_id % 20 AS id, ts, event_id FROM events), l AS (SELECT *, lag(ts) OVER (PARTITION BY mission, tool, id ORDER BY ts, event_id) AS prev FROM e)
    SELECT event_id, prev IS NOT NULL AND ts - prev <= INTERVAL 12 HOUR AS already_read FROM l"""
)
def registry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD-REGISTRY: a read is known when the same target was read within twelve hours."""
    e = table(spark, sf_dir, "events").selectExpr("user_id % 50 mission", "event_type tool", "user_id % 20 id", "ts", "event_id")
    prev = F.lag("ts").over(Window.partitionBy("mission", "tool", "id").orderBy("ts", "event_id"))
    return e.select("event_id", (prev.isNotNull() & (F.col("ts") <= prev + F.expr("INTERVAL 12 HOURS"))).alias("already_read"))


@query(
    """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events) SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
    count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM e"""
)
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-QUOTA: requests of a provider within the last hour against its quota."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return in_window(e, 3600000000).select("event_id", "in_window", (F.col("in_window") <= 5).alias("allowed"))


#: Microseconds of a stretch of time whose events are counted by one task.
STRETCH = 60_000_000


def in_window(e: DataFrame, width: int) -> DataFrame:
    """(event_id, in_window): events of the type at most `width` earlier, of (event_id, event_type, us).

    An event counts from its own time on until the window has passed. The
    running sum of what comes and goes is made in short stretches, and what
    stood at the start of a stretch is added. Events without a time count each other.
    """
    comes = e.select("event_id", "event_type", "us", F.lit(1).alias("step"))
    goes = e.where("us IS NOT NULL").select(F.lit(None).cast(e.schema["event_id"].dataType).alias("event_id"), "event_type", (F.col("us") + width + 1).alias("us"), F.lit(-1).alias("step"))
    steps = comes.unionByName(goes).withColumn("stretch", F.floor(F.col("us") / STRETCH))
    before = Window.partitionBy("event_type").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    start = steps.where("stretch IS NOT NULL").groupBy("event_type", "stretch").agg(F.sum("step").alias("sum")).select(F.col("event_type").alias("t"), F.col("stretch").alias("s"), F.sum("sum").over(before).alias("start"))
    within = F.sum("step").over(Window.partitionBy("event_type", "stretch").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    counted = steps.withColumn("n", within).where("step = 1")
    found = counted.join(start, F.col("event_type").eqNullSafe(F.col("t")) & (F.col("stretch") == F.col("s")), "left")
    return found.select("event_id", (F.col("n") + F.coalesce("start", F.lit(0))).alias("in_window"))


@query(
    """WITH t AS (SELECT * FROM (VALUES (1, 'alpha beta gamma', 'beta', 'BETA'), (2, 'one two one', 'one', 'x'), (3, 'abc', 'zzz', 'y')) AS t(id, text, anchor, repl)), c AS (SELECT *, CAST((length(text) - length(replace(text, anchor, ''))) / length(anchor) AS BIGINT) AS n FROM t)
    SELECT id, n AS occurrences, CASE WHEN n = 1 THEN replace(text, anchor, repl) END AS edited, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS outcome FROM c"""
)
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDT-LOCATE and EDT-APPLY: a replacement at a unique anchor, as a new version of the text."""
    t = spark.createDataFrame([(1, "alpha beta gamma", "beta", "BETA"), (2, "one two one", "one", "x"), (3, "abc", "zzz", "y")], "id int, text string, anchor string, repl string")
    n = ((F.char_length("text") - F.char_length(F.replace("text", "anchor", F.lit("")))) / F.char_length("anchor")).cast("bigint")
    return t.withColumn("occurrences", n).select("id", "occurrences", F.when(F.col("occurrences") == 1, F.replace("text", "anchor", "repl")).alias("edited"), F.when(F.col("occurrences") == 0, "missing").when(F.col("occurrences") > 1, "ambiguous").otherwise("ok").alias("outcome"))


@query(
    """WITH e AS (SELECT l_orderkey AS file, l_linenumber AS edit, l_partkey % 90 AS a, l_partkey % 90 + l_suppkey % 7 AS b FROM lineitem)
    SELECT DISTINCT x.file, x.edit AS first_edit, y.edit AS second_edit FROM e x JOIN e y ON x.file = y.file AND x.edit < y.edit AND x.a <= y.b AND y.a <= x.b"""
)
def edit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDT-OVERLAP: edits of a file that touch the same lines are refused."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey file", "l_linenumber edit", "l_partkey % 90 a", "l_partkey % 90 + l_suppkey % 7 b")
    x, y = e.selectExpr("file", "edit first_edit", "a xa", "b xb"), e.selectExpr("file", "edit second_edit", "a ya", "b yb")
    return x.join(y, "file").where("first_edit < second_edit AND xa <= yb AND ya <= xb").select("file", "first_edit", "second_edit").distinct()
