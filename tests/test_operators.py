"""Properties that the SQL comparison does not reach."""

import pandas as pd
import pytest

from lorekeep.functions import text as tx
from lorekeep.operators.logs import blocks_of, decode_mappings, vlq
from lorekeep.operators.maintenance import merged
from lorekeep.operators.retrieval import bm25, question_terms, top
from lorekeep.operators.selection import take_greedy
from lorekeep.sources.tables import table
from lorekeep.streaming.state import breaker_rows, breaker_stream, next_breaker, next_delay, throttle_rows, throttle_stream


def test_top_k_is_a_prefix(spark, sf):
    docs, q = table(spark, sf, "documents"), question_terms(table(spark, sf, "benchmark"))
    scores = bm25(docs, q)
    short = {(r.item_id, r.rank, r.doc_id) for r in top(scores, 5).collect()}
    long = {(r.item_id, r.rank, r.doc_id) for r in top(scores, 20).collect()}
    assert short == {x for x in long if x[1] <= 5}


def test_deltas_equal_rebuild(spark):
    seg = spark.createDataFrame([(1, 0, 1, 5.0, False), (1, 1, 2, 6.0, False), (2, 0, 1, 1.0, False), (2, 2, 3, 0.0, True), (3, 1, 1, 9.0, False)], "id int, segment int, version int, value double, tombstone boolean")
    once = merged(seg)
    step = merged(seg.where("segment < 2")).selectExpr("id", "segment", "version", "value", "false tombstone").union(seg.where("segment = 2"))
    assert sorted(once.collect()) == sorted(merged(step).collect())


def test_greedy_stays_within_the_budget():
    facts = pd.DataFrame([(1, i, i % 2, "def", 1, 10.0 - i, 10) for i in range(8)], columns=["q_id", "fact", "seed", "kind", "file", "value", "cost"])
    out = take_greedy(facts, 35)
    assert out["cost"].sum() <= 35 and len(out) == 3 and out["fact"].iloc[0] == 0


def test_vlq():
    assert [vlq(x) for x in ("A", "C", "D", "gB", "gkxH")] == [[0], [1], [-1], [16], [123456]]
    assert decode_mappings("AAAA;AACA") == [(0, 0, 0, 0, 0), (1, 0, 0, 1, 0)]


def test_blocks():
    lines = pd.DataFrame([(1, i, c) for i, c in enumerate([0, 3, 2, 2, 0, 2, 3, 3, 2])], columns=["file", "line_no", "cls"])
    assert blocks_of(lines).values.tolist() == [[1, 1, 3], [1, 6, 6], [1, 7, 8]]


def test_failure_blocks_match_the_sequential_form(spark, sf):
    from pyspark.sql import functions as F

    from lorekeep.operators.logs import failure_blocks, line_class_of, log_lines

    p = log_lines(spark, sf).select("file", "line_no", line_class_of(F.col("line")).alias("cls")).toPandas()
    want = sorted(tuple(r) for _, g in p.groupby("file") for r in blocks_of(g).values.tolist())
    assert sorted(tuple(r) for r in failure_blocks(spark, sf).collect()) == want


def test_delay_and_breaker():
    assert next_delay(250, 1000, 200) == 1000 and next_delay(1000, 0, 200) == 812.5
    assert next_delay(400, 10, 429) == 800 and next_delay(400, 10, 200, 90_000) == 60_000
    state = (0, 0.0)
    for t in range(3):
        *state, ok = next_breaker(*state, float(t), False)
        assert ok
    assert next_breaker(*state, 10.0, True)[2] is False and next_breaker(*state, 1000.0, True)[2] is True


@pytest.mark.parametrize("kind", ["throttle", "breaker"])
def test_streams_equal_batch(spark, sf, tmp_path, kind):
    from lorekeep.streaming.state import crawl_events

    events = crawl_events(spark, sf)
    if kind == "breaker":
        events = events.withColumnRenamed("host", "provider")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = (throttle_stream if kind == "throttle" else breaker_stream)(stream)
    q = out.writeStream.format("memory").queryName(f"out_{kind}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table(f"out_{kind}").collect())
    p = events.toPandas()
    if kind == "throttle":
        want = [r for host, g in p.groupby("host") for r in throttle_rows(host, 250.0, g)[1].itertuples(index=False, name=None)]
    else:
        want = [r for k, g in p.groupby("provider") for r in breaker_rows(k, (0, 0.0), g)[1].itertuples(index=False, name=None)]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and [str(x[2]) for x in got] == [str(x[2]) for x in sorted(want)]


def test_glob():
    import re

    assert re.match(tx.glob_regex("**/a.py"), "a.py") and re.match(tx.glob_regex("**/a.py"), "x/y/a.py")
    assert re.match(tx.glob_regex("src/*"), "src/a/b") and not re.match(tx.glob_regex("s?c"), "sc")


def test_ident(spark):
    rows = spark.createDataFrame([("parseHTTPResponse_v2",), ("",)], "n string").select(tx.ident_tokens(__import__("pyspark").sql.functions.col("n")).alias("t")).collect()
    assert rows[0].t == ["parse", "http", "response", "v2", "parsehttpresponse_v2"] and rows[1].t == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
