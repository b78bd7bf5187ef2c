"""Ties, and steps whose sorts, tables or exchanges must not grow beyond their input."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import graph, retrieval, scan
from lorekeep.plans.catalog import ORACLE_SQL, QUERIES


def against_sql(spark, folder, name, tables):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, QUERIES[name](spark, str(folder)).select(names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.fetchall()))


def test_equal_best_hits_of_versions(spark, tmp_path):
    rng = random.Random(3)
    n = 600
    columns = {"o_orderkey": pa.array(range(n)), "o_custkey": pa.array([rng.randrange(60) for _ in range(n)]), "o_orderstatus": [rng.choice("OFP") for _ in range(n)], "o_totalprice": pa.array([float(rng.randrange(3)) for _ in range(n)])}
    pq.write_table(pa.table(columns), tmp_path / "orders.parquet")
    against_sql(spark, tmp_path, "also_in_version", ["orders"])


def test_nearest_in_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    few = np.round(rng.normal(size=(40, 5)), 1).astype(np.float32)  # many equal vectors: ties by id
    rows = [few[k % 40].tolist() if k % 90 else None for k in range(1, 400)]
    pq.write_table(pa.table({"vec_id": pa.array(range(1, 400)), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    monkeypatch.setattr(retrieval, "VECTORS", 60)
    monkeypatch.setattr(retrieval, "ASKING", 3)
    against_sql(spark, tmp_path, "dense_knn", ["embeddings"])


SCORED = ["abstention_curve", "best_hit_coverage", "bm25_eval", "bm25_top20", "bm25f_names_body", "confidence_abstain", "coverage_multiplier", "grep_count_rank", "grep_terms_rank", "percentiles", "recall_at_k", "rerank20", "rrf_fusion", "tokens_to_first", "web_bm25f"]


@pytest.fixture(scope="module")
def asked(tmp_path_factory):
    """Questions and documents of few words: many ties, null texts, short and absent questions, an id on two equal rows."""
    d, rng = tmp_path_factory.mktemp("asked"), random.Random(8)
    words = ["Été", "straße", "x9", "the", "fox", "42", "Ωmega", "naïve", "a", "b", "c"]
    said = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    texts = [said(rng.randrange(1, 30)) for _ in range(150)] + [None, "", "one\ntwo"] * 2
    questions = [said(rng.randrange(1, 8)).replace("\n", " ") for _ in range(25)] + ["zzz yyy", "zzz the yyy xxx qqq"]
    texts += [f"{said(3)} {q} {said(2)}" for q in questions[::3]]
    texts.append(texts[7])
    ids = [*range(len(texts) - 1), 7]
    pq.write_table(pa.table({"doc_id": pa.array(ids), "text": texts, "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts])}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(questions))), "text": questions}), d / "benchmark.parquet")
    pages = [f"<title>{said(2)}</title><p>{said(9)}</p>" for _ in range(40)] + ["<p></p>"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(pages))), "html": pages}), d / "pages.parquet")
    return d


@pytest.mark.parametrize("name", SCORED)
def test_questions_in_blocks_and_batches(spark, asked, monkeypatch, name):
    monkeypatch.setattr(scan, "SENT", 40)
    monkeypatch.setattr(scan, "CELLS", 64)
    against_sql(spark, asked, name, ["documents", "benchmark", "pages"])


def test_only_the_best_of_a_task_are_exchanged(spark, sf):
    docs, q = spark.read.parquet(f"{sf}/documents.parquet"), retrieval.question_terms(spark.read.parquet(f"{sf}/benchmark.parquet"))
    found = retrieval.bm25(docs, q, best=3)
    assert max(Counter((r.item_id) for r in found.collect()).values()) <= 3 * found.rdd.getNumPartitions()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_stems_by_word(spark):
    words = ["ponies", "classes", "running", "stopped", "bigger", "bed", "making", "nations", "organization", "darkness", "ties", "abbess", "loving", "house", "cities", "quickly", "wiser", "tree", "pssst", "hopped", "eding", "ionment"]
    words += [a + b for a in ("mat", "runn", "abcd", "ll") for b in ("ies", "s", "ing", "ed", "er", "ity", "ation", "tion", "ments", "e", "ly")]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == {w: tx.stem_word(w) for w in words}


def test_bags_are_counted_where_documents_are_read(spark, asked):
    against_sql(spark, asked, "body_terms", ["documents"])
    plan = QUERIES["body_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_windows_in_stretches(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    ts = [start + timedelta(seconds=rng.choice([0, 1, 59, 60, 3600, 3601, 7200]) + rng.randrange(3), microseconds=rng.choice([0, 1])) for _ in range(400)] + [None] * 3
    kinds = [rng.choice(["a", "b", None]) for _ in ts]
    pq.write_table(pa.table({"event_id": pa.array(range(len(ts))), "event_type": kinds, "ts": pa.array(ts, pa.timestamp("us"))}), tmp_path / "events.parquet")
    against_sql(spark, tmp_path, "quota_window", ["events"])
    plan = QUERIES["quota_window"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "-3600000000" not in plan  # no frame that is gone through again for each row


def test_links_of_few_nodes_stay_where_they_are_read(spark, sf, tmp_path, monkeypatch):
    joined = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: joined.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    want = sorted(map(tuple, QUERIES["shortest_path"](spark, sf).collect()))
    assert sum("strategy=broadcast" in p for p in joined) >= 4
    monkeypatch.setattr(graph, "SENT", 0)
    assert sorted(map(tuple, QUERIES["shortest_path"](spark, sf).collect())) == want


def test_hunks_that_share_lines_are_looked_up_once(spark, tmp_path):
    rng, n = random.Random(6), 300
    pq.write_table(pa.table({"l_orderkey": pa.array([rng.randrange(40) for _ in range(n)]), "l_linenumber": pa.array([rng.randrange(1, 8) for _ in range(n)], pa.int32()), "l_suppkey": pa.array([rng.randrange(4) for _ in range(n)]), "l_partkey": pa.array([rng.randrange(500) for _ in range(n)])}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": pa.array(range(n)), "o_custkey": pa.array([rng.randrange(5) for _ in range(n)])}), tmp_path / "orders.parquet")
    against_sql(spark, tmp_path, "hunk_overlap", ["lineitem", "orders"])
    plan = QUERIES["hunk_overlap"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
