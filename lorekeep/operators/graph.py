"""Graph operators on derived edges: resolution, traversal, cards, overviews.

The test data's graph: suppliers supply parts (lineitem), customers hold
orders, nations lie in regions. Traversals are frontier loops in which each
level is a join with the edges and an anti-join with what was seen; levels
are bounded and each is cut by a written table, so that no plan grows with
the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

EDGES_SQL = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row is a link."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).distinct()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints/lorekeep")
    return df.checkpoint()


def bfs(links: DataFrame, seeds: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """(node, depth) reached from the seeds over directed (src, dst) links.

    cap: most nodes of the result, nearest first, then by name (a feature of
    the impact report, none by default).
    """
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = links.join(sent(front.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen.orderBy("depth", "node").limit(cap) if cap else seen


#: Most nodes that are sent to all tasks; the links of more nodes are exchanged.
SENT = 1_000_000


def sent(nodes: DataFrame) -> DataFrame:
    """A table of nodes, sent to all tasks where these are few, as counted: links then stay where they are read."""
    return F.broadcast(nodes) if nodes.limit(SENT + 1).count() <= SENT else nodes


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    walk(node, depth) AS (SELECT 's1', 0 UNION SELECT b.dst, depth + 1 FROM walk JOIN both_ways b ON b.src = walk.node WHERE depth < 3)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node"""
)
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-IMPACT: what a change reaches within three steps, with the first depth."""
    return bfs(both_ways(links_of(spark, sf_dir)), spark.createDataFrame([("s1",)], "node string"), 3)


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    walk(node, depth) AS (SELECT 's1', 0 UNION SELECT b.dst, depth + 1 FROM walk JOIN both_ways b ON b.src = walk.node WHERE depth < 4), d AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
    par AS (SELECT d.node, d.depth, min(p.node) AS parent FROM d JOIN both_ways b ON b.dst = d.node JOIN d p ON p.node = b.src AND p.depth = d.depth - 1 GROUP BY ALL),
    back(node, depth) AS (SELECT 's7', depth FROM d WHERE node = 's7' UNION ALL SELECT par.parent, par.depth - 1 FROM back JOIN par ON par.node = back.node WHERE par.depth > 0)
    SELECT node, CAST(depth AS INTEGER) AS step FROM back"""
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-PATH: a shortest path between two nodes; the smallest parent wins ties."""
    links = both_ways(links_of(spark, sf_dir))
    reached = bfs(links, spark.createDataFrame([("s1",)], "node string"), 4)
    step = reached.where("node = 's7'").select("node", F.col("depth").alias("step"))
    path = step
    for _ in range(4):
        # of the node reached last (one row), the smallest neighbour a step nearer
        near = links.join(F.broadcast(step.select(F.col("node").alias("dst"), "step")), "dst").select(F.col("src").alias("node"), F.col("step") - 1).distinct()
        step = cut(near.toDF("node", "step").join(reached, "node").where("depth = step").groupBy("step").agg(F.min("node").alias("node")).select("node", "step"))
        path = path.unionByName(step)
    return path


@query(
    f"""WITH {EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
    SELECT node, CAST((SELECT count(*) FROM edges WHERE src = node) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM edges WHERE dst = node) AS BIGINT) AS in_degree FROM n"""
)
def overview_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-OVERVIEW: links out of and into each node, one pass over the edges."""
    e = edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").cast("bigint").alias("out_degree"), F.sum("i").cast("bigint").alias("in_degree"))


@query(
    """SELECT r_name AS zone, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS folders, CAST(count(c_custkey) AS BIGINT) AS symbols, round(coalesce(sum(c_acctbal), 0), 2) AS weight
    FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name"""
)
def zone_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-OVERVIEW: zones with their folders and symbols."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.sum("c_acctbal").alias("w"))
    out = r.join(n, r.r_regionkey == n.n_regionkey).join(per, n.n_nationkey == per.c_nationkey, "left")
    return out.groupBy(F.col("r_name").alias("zone")).agg(F.count_distinct("n_nationkey").alias("folders"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("symbols"), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 2).alias("weight"))


_IMPORTS = [("src/app.ts", "./util"), ("src/app.ts", "@/lib/db"), ("src/app.ts", "react"), ("src/lib/db.ts", "../util"), ("src/page.ts", "lib"), ("src/page.ts", "./page")]
_TREE = ["src/app.ts", "src/util.ts", "src/lib/db.ts", "src/lib/index.ts", "src/page.ts"]


def _values(rows, names):
    cells = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) AS t({names}))"


@query(
    rf"""WITH i AS {_values(_IMPORTS, 'src, spec')}, f AS {_values([(t,) for t in _TREE], 'path')},
    k AS (SELECT path, regexp_replace(path, '\.[a-z]+$', '') AS base, regexp_extract(path, '([^/]*)\.[a-z]+$', 1) AS stem FROM f),
    s AS (SELECT src, spec, regexp_replace(regexp_replace(spec, '^@/', 'src/'), '^(\./|\.\./)+', '') AS tail FROM i)
    SELECT DISTINCT src, spec, path AS target FROM s JOIN k ON (base = tail OR stem = regexp_extract(tail, '[^/]*$') OR base = tail || '/index' OR ends_with(base, '/' || tail || '/index')) WHERE path <> src"""
)
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-IMPORT: specifiers to files by path, by stem or as a folder's index; itself excluded."""
    i, f = spark.createDataFrame(_IMPORTS, "src string, spec string"), spark.createDataFrame([(t,) for t in _TREE], "path string")
    k = f.select("path", F.regexp_replace("path", r"\.[a-z]+$", "").alias("base"), F.regexp_extract("path", r"([^/]*)\.[a-z]+$", 1).alias("stem"))
    s = i.select("src", "spec", F.regexp_replace(F.regexp_replace("spec", "^@/", "src/"), r"^(\./|\.\./)+", "").alias("tail"))
    return resolve_imports(s, k)


def resolve_imports(s: DataFrame, k: DataFrame) -> DataFrame:
    """Equi-joins on three derived keys, laid end to end."""
    keys = k.select("path", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("b:"), "base"), F.concat(F.lit("s:"), "stem")), F.transform(F.filter(F.split(F.regexp_extract("base", "^(.*)/index$", 1), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("d:"), x))))).alias("key"))
    folder = k.where(F.col("base").rlike("/index$")).select("path", F.regexp_extract("base", "^(.*)/index$", 1).alias("dir"))
    folder_keys = folder.select("path", F.explode(F.expr("transform(sequence(1, size(split(dir, '/'))), i -> concat('f:', array_join(slice(split(dir, '/'), -i, i), '/')))")).alias("key"))
    wanted = s.select("src", "spec", F.explode(F.array(F.concat(F.lit("b:"), "tail"), F.concat(F.lit("s:"), F.regexp_extract("tail", "[^/]*$", 0)), F.concat(F.lit("f:"), "tail"))).alias("key"))
    return wanted.join(keys.union(folder_keys), "key").where("path <> src").select("src", "spec", F.col("path").alias("target")).distinct()


_DEFS_SQL = "defs AS (SELECT c_custkey AS id, 'f' || (c_custkey % 97) AS name, c_nationkey AS file FROM customer), calls AS (SELECT o_orderkey AS call_id, 'f' || (o_custkey % 131) AS name, o_orderkey % 25 AS file FROM orders), imports AS (SELECT n_nationkey AS file, n_regionkey AS target FROM nation)"


@query(
    f"""WITH {_DEFS_SQL}, c AS (SELECT call_id, calls.name, id, CASE WHEN defs.file = calls.file THEN 1 WHEN i.target IS NOT NULL THEN 2 ELSE 3 END AS tier
      FROM calls JOIN defs ON defs.name = calls.name LEFT JOIN imports i ON i.file = calls.file AND i.target = defs.file),
    t AS (SELECT call_id, min(id) FILTER (tier = 1) AS own, count(*) FILTER (tier = 2) AS n2, min(id) FILTER (tier = 2) AS i2, count(*) AS n, min(id) AS any_id FROM c GROUP BY call_id)
    SELECT calls.call_id, CASE WHEN own IS NOT NULL THEN own WHEN n2 = 1 THEN i2 WHEN n2 = 0 AND n = 1 THEN any_id END AS target,
      CASE WHEN own IS NOT NULL THEN 'same file' WHEN n2 = 1 THEN 'import' WHEN n2 = 0 AND n = 1 THEN 'unique' WHEN n > 0 THEN 'ambiguous' ELSE 'external' END AS how FROM calls LEFT JOIN t USING (call_id)"""
)
def call_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-CALL: same file, else the one imported definition, else the only one, else ambiguous."""
    defs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("f"), (F.col("c_custkey") % 97).cast("string")).alias("name"), F.col("c_nationkey").alias("dfile"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 131).cast("string")).alias("name"), (F.col("o_orderkey") % 25).cast("int").alias("file"))
    imports = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("dfile")).distinct()
    # definitions are counted by (name, file) and by name; calls of a name in a file are resolved once
    per_file = defs.groupBy("name", "dfile").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("low"))
    per_name = per_file.groupBy("name").agg(F.sum("k").alias("n"), F.min("low").alias("any_id"))
    asked = calls.select("name", "file").distinct()
    own = per_file.select("name", F.col("dfile").alias("file"), F.col("low").alias("own"))
    imported = asked.join(imports, "file").where(F.col("dfile") != F.col("file")).join(per_file, ["name", "dfile"]).groupBy("name", "file").agg(F.sum("k").alias("n2"), F.min("low").alias("i2"))
    found = asked.join(per_name, "name", "left").join(own, ["name", "file"], "left").join(imported, ["name", "file"], "left").fillna(0, ["n", "n2"])
    t = calls.join(found, ["name", "file"])
    one = (F.col("n2") == 0) & (F.col("n") == 1)
    return t.select("call_id", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("n2") == 1, F.col("i2")).when(one, F.col("any_id")).alias("target"), F.when(F.col("own").isNotNull(), "same file").when(F.col("n2") == 1, "import").when(one, "unique").when(F.col("n") > 0, "ambiguous").otherwise("external").alias("how"))


_SPANS_SQL = "spans AS (SELECT o_orderkey AS sym, o_custkey AS file, (o_orderkey % 50) * 4 AS first, (o_orderkey % 50) * 4 + 10 + o_orderkey % 60 AS last FROM orders), marks AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS mark, l_suppkey AS file, (l_partkey % 240) AS line FROM lineitem)"


@query(f"WITH {_SPANS_SQL} SELECT mark, m.file, line, arg_min(sym, (last - first) * 100000000 + sym) AS caller FROM marks m JOIN spans s ON s.file = m.file AND line BETWEEN first AND last GROUP BY ALL")
def callers_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-CALLSCOPE and JN-CALLERS: each call line's innermost symbol.

    Range join: spans are cut at multiples of BIN lines, so that the join is an
    equi-join on (file, bin) whatever the number of symbols of a file.
    """
    return innermost(*_spans(spark, sf_dir))


BIN = 32


def _spans(spark: SparkSession, sf_dir: str):
    spans = table(spark, sf_dir, "orders").selectExpr("o_orderkey sym", "o_custkey file", "(o_orderkey % 50) * 4 first", "(o_orderkey % 50) * 4 + 10 + o_orderkey % 60 last")
    marks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber mark", "l_suppkey file", "l_partkey % 240 line")
    return marks, spans


def innermost(marks: DataFrame, spans: DataFrame) -> DataFrame:
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor(F.col("last") / BIN))))
    hit = marks.withColumn("bin", F.floor(F.col("line") / BIN)).join(binned, ["file", "bin"]).where("line BETWEEN first AND last")
    return hit.groupBy("mark", "file", "line").agg(F.min_by("sym", F.struct(F.col("last") - F.col("first"), F.col("sym"))).alias("caller"))


@query(
    f"""WITH {_SPANS_SQL}, hunks AS (SELECT mark, file, line AS a, line + 6 AS b FROM marks), h AS (SELECT mark, file, a, sym, first, last FROM hunks JOIN spans USING (file) WHERE first <= b AND last >= a)
    SELECT DISTINCT mark, sym FROM h WHERE NOT EXISTS (SELECT 1 FROM h i WHERE i.mark = h.mark AND i.file = h.file AND i.a = h.a AND i.sym <> h.sym AND i.first >= h.first AND i.last <= h.last AND (i.last - i.first) < (h.last - h.first))"""
)
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-HUNK: symbols that changed line ranges touch, without those that hold another touched one."""
    marks, spans = _spans(spark, sf_dir)
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    # which symbols count depends on file and lines alone: hunks that share them are looked up once
    hunks = marks.selectExpr("file", "line a").distinct()
    binned = spans.withColumn("bin", F.explode(F.sequence(bin_of("first"), bin_of("last"))))
    asked = hunks.withColumn("bin", F.explode(F.sequence(bin_of("a"), F.floor((F.col("a") + 6) / BIN))))
    # a hunk and a symbol meet in the first bin that both have
    met = asked.join(binned, ["file", "bin"]).where(F.col("bin") == F.greatest(bin_of("a"), bin_of("first"))).where("first <= a + 6 AND last >= a")
    h = met.groupBy("file", "a").agg(F.collect_set(F.struct("sym", "first", "last")).alias("h"))
    holds = lambda x, i: (i["sym"] != x["sym"]) & (i["first"] >= x["first"]) & (i["last"] <= x["last"]) & (i["last"] - i["first"] < x["last"] - x["first"])
    kept = h.select("file", F.col("a").alias("line"), F.transform(F.filter("h", lambda x: ~F.exists("h", lambda i: holds(x, i))), lambda x: x["sym"]).alias("syms"))
    return marks.join(kept, ["file", "line"]).select("mark", F.explode("syms").alias("sym")).distinct()


@query(
    """WITH m AS (SELECT o_custkey AS script, o_orderkey AS col, o_orderpriority AS name FROM orders), q AS (SELECT l_orderkey * 8 + l_linenumber AS query_id, l_partkey % 150 + 1 AS script, l_orderkey AS col FROM lineitem)
    SELECT query_id, q.script, q.col, m.col AS segment, m.name FROM q ASOF LEFT JOIN m ON q.script = m.script AND q.col >= m.col"""
)
def asof_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-ASOF: the last segment at or before each position: union, sort and carry forward."""
    m = table(spark, sf_dir, "orders").selectExpr("o_custkey script", "o_orderkey col", "o_orderpriority name")
    q = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber query_id", "l_partkey % 150 + 1 script", "l_orderkey col")
    return asof(q, m)


def asof(q: DataFrame, m: DataFrame) -> DataFrame:
    """One shuffle: both sides in one stream by (script, col), segments first at ties."""
    both = m.select("script", "col", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"), F.struct("col", "name").alias("seg")).unionByName(q.select("script", "col", F.lit(1).alias("kind"), F.col("query_id").cast("bigint"), F.lit(None).cast("struct<col: bigint, name: string>").alias("seg")))
    last = F.last("seg", True).over(Window.partitionBy("script").orderBy("col", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("seg", last).where("kind = 1").select("query_id", "script", "col", F.col("seg.col").alias("segment"), F.col("seg.name").alias("name"))


@query(
    f"""WITH {EDGES_SQL} SELECT src AS node, CAST(count(*) AS BIGINT) AS n_callees, array_to_string(list_slice(list_sort(list(dst)), 1, 6), ',') AS shown FROM edges GROUP BY src"""
)
def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-CARD: number of callees and the first six."""
    return edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_callees"), F.array_join(F.slice(F.sort_array(F.collect_list("dst")), 1, 6), ",").alias("shown"))


@query(
    f"""WITH {EDGES_SQL}, c AS (SELECT DISTINCT src AS dependant, dst AS node FROM edges), i AS (SELECT DISTINCT 'c' || l_suppkey AS dependant, 'p' || l_partkey AS node FROM lineitem)
    SELECT dependant, node FROM c UNION SELECT dependant, node FROM i"""
)
def dependants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-DEPENDANTS: callers, and importers that do not call."""
    c = edges(spark, sf_dir).select(F.col("src").alias("dependant"), F.col("dst").alias("node"))
    i = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    return c.union(i).distinct()


_REEXPORTS = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("d", "e")]


@query(
    f"""WITH RECURSIVE e AS {_values(_REEXPORTS, 'src, dst')}, w(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT w.src, e.dst, depth + 1 FROM w JOIN e ON e.src = w.dst WHERE depth < 4)
    SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL"""
)
def reexport_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-REEXPORT: re-export chains, four links at most, cycles included once."""
    e = spark.createDataFrame(_REEXPORTS, "src string, dst string")
    level = e.withColumn("depth", F.lit(1))
    out = level
    for d in range(2, 5):
        level = cut(level.select("src", F.col("dst").alias("mid")).join(e.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct().withColumn("depth", F.lit(d)))
        out = out.unionByName(level)
    return out.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS file FROM customer)
    SELECT o_orderkey AS mention, min(CASE WHEN o_custkey = id AND o_orderkey % 25 = file THEN 0 WHEN o_custkey = id THEN 1 ELSE 2 END)::INTEGER AS tier, CAST(count(*) AS BIGINT) AS candidates FROM orders JOIN c ON o_custkey % 50 = id % 50 GROUP BY o_orderkey"""
)
def proof_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-PROOF: best proof tier of a mention among its candidates, and their number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("file"), (F.col("c_custkey") % 50).alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mention"), "o_custkey", (F.col("o_custkey") % 50).alias("k"))
    # only a candidate of the same key proves more than the class: two equi-joins instead of all pairs of a class
    per_class = c.groupBy("k").agg(F.count(F.lit(1)).alias("candidates"))
    named = c.groupBy(F.col("id").alias("o_custkey")).agg(F.lit(True).alias("named"))
    placed = c.select(F.col("id").alias("o_custkey"), F.col("file").cast("bigint").alias("place")).distinct().withColumn("placed", F.lit(True))
    joined = o.withColumn("place", (F.col("mention") % 25).cast("bigint")).join(per_class, "k").join(named, "o_custkey", "left").join(placed, ["o_custkey", "place"], "left")
    tier = F.when(F.col("placed"), 0).when(F.col("named"), 1).otherwise(2)
    return joined.groupBy("mention").agg(F.min(tier).alias("tier"), F.sum("candidates").alias("candidates"))
