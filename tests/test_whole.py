"""Queries that must take every row, against brute force or SQL without filters."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorekeep.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def li():
    """(orderkey, linenumber, suppkey, partkey), suppliers and lines above every old limit, keys not unique."""
    r = random.Random(5)
    return [(r.randrange(1, 60), r.randrange(1, 8), r.randrange(1, 90), r.randrange(1, 120)) for _ in range(240)]


@pytest.fixture(scope="module")
def small(tmp_path_factory, li):
    d = tmp_path_factory.mktemp("whole")
    o, n, s, p = zip(*li, strict=True)
    put = lambda name, **c: pq.write_table(pa.table(c), f"{d}/{name}.parquet")
    put("lineitem", l_orderkey=pa.array(o, pa.int64()), l_linenumber=pa.array(n, pa.int32()), l_suppkey=pa.array(s, pa.int64()), l_partkey=pa.array(p, pa.int64()))
    k = list(range(1, 400))
    put("orders", o_orderkey=pa.array(k, pa.int64()), o_custkey=pa.array([x * 7 % 90 + 1 for x in k], pa.int64()), o_orderpriority=[f"n{x}" for x in k])
    put("part", p_partkey=pa.array(range(1, 120), pa.int64()))
    return str(d)


def out(spark, small, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, small).collect())


def walk(li, depth):
    seen, front = {"s1": 0}, {"s1"}
    for d in range(1, depth + 1):
        front = {b for _, _, s, p in li for a, b in ((f"s{s}", f"p{p}"), (f"p{p}", f"s{s}")) if a in front} - set(seen)
        seen |= dict.fromkeys(front, d)
    return seen


def test_edges_of_every_row(spark, small, li):
    links = {(f"s{s}", f"p{p}") for _, _, s, p in li}
    assert out(spark, small, "impact_bfs") == sorted(walk(li, 3).items())
    ends = {x for e in links for x in e}
    assert out(spark, small, "overview_degrees") == sorted((x, sum(a == x for a, _ in links), sum(b == x for _, b in links)) for x in ends)
    of = {s: sorted(b for a, b in links if a == s) for s, _ in links}
    assert out(spark, small, "card") == sorted((s, len(x), ",".join(x[:6])) for s, x in of.items())
    assert out(spark, small, "dependants") == sorted(links | {("c" + a[1:], b) for a, b in links})


def test_path_over_every_row(spark, small, li):
    depth = walk(li, 4)
    links = {(f"s{s}", f"p{p}") for _, _, s, p in li}
    both = links | {(b, a) for a, b in links}
    path = [("s7", depth["s7"])]
    while path[-1][1]:
        node, d = path[-1]
        path.append((min(a for a, b in both if b == node and depth.get(a) == d - 1), d - 1))
    assert out(spark, small, "shortest_path") == sorted(path)


def test_edits_of_every_file(spark, small, li):
    e = [(o, n, p % 90, p % 90 + s % 7) for o, n, s, p in li]
    want = {(f, x, y) for f, x, a, b in e for g, y, c, d in e if f == g and x < y and a <= d and c <= b}
    assert any(f % 10 != 1 for f, _, _ in want)
    assert out(spark, small, "edit_overlap") == sorted(want)


@pytest.fixture(scope="module")
def asked(tmp_path_factory):
    """A question whose only word found in documents and pages is its tenth."""
    d = tmp_path_factory.mktemp("asked")
    put = lambda name, **c: pq.write_table(pa.table(c), f"{d}/{name}.parquet")
    put("benchmark", item_id=[1], text=["one two three four five six seven eight nine zebra One"])
    put("documents", doc_id=[1, 2, 3], text=["Zebra\nzebra herd", "plain\ngrass", "other\nzebra"], lang=["en"] * 3, source=["src1"] * 3)
    put("pages", page_id=[1, 2], html=["<title>zebra</title><p>herd", "<title>x</title><p>y"])
    return str(d)


def test_whole_questions(spark, asked):
    got = {name: {tuple(r)[1]: r for r in QUERIES[name](spark, asked).collect()} for name in ("bm25f_names_body", "coverage_multiplier", "web_bm25f")}
    assert set(got["bm25f_names_body"]) == {1, 3} and got["bm25f_names_body"][1].rank == 1
    assert {k: r.multiplier for k, r in got["coverage_multiplier"].items()} == {1: 3.0}
    assert set(got["web_bm25f"]) == {1}


def test_whole_questions_against_sql(spark, sf):
    """The registered SQL with its list_slice taken out."""
    import re

    import duckdb

    from lorekeep.plans.catalog import ORACLE_SQL

    con = duckdb.connect()
    for t in ("benchmark", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("bm25f_names_body", "coverage_multiplier", "web_bm25f"):
        sql = re.sub(r"list_slice\((regexp_extract_all\(lower\(text\), '[^']*'\)), 1, [46]\)", r"\1", ORACLE_SQL[name])
        df = QUERIES[name](spark, sf)
        want = con.execute(sql).to_arrow_table().select(df.columns).to_pylist()
        key = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else v for v in r)
        assert sorted(key(tuple(r)) for r in df.collect()) == sorted(key(tuple(r.values())) for r in want)


def test_interleave_every_page(spark, tmp_path):
    urls = [f"u{i * 7 % 83}" for i in range(120)]
    pq.write_table(pa.table({"page_id": pa.array(range(120), pa.int64()), "url": urls}), f"{tmp_path}/pages.parquet")
    seen = {}
    for i in range(120):
        for page, key in ((i, i), (119 - i, 1119 - i)):
            seen.setdefault(urls[page], key)
    assert sorted(out(spark, str(tmp_path), "interleave_dedup"), key=lambda r: r[2]) == [(k, u, n) for n, (u, k) in enumerate(seen.items(), 1)]


def spans():
    return [(k, k * 7 % 90 + 1, k % 50 * 4, k % 50 * 4 + 10 + k % 60) for k in range(1, 400)]


def test_marks_of_every_row(spark, small, li):
    marks = {(o * 8 + n, s, p % 240) for o, n, s, p in li}
    hit = {m: [(b - a, k) for k, f, a, b in spans() if f == m[1] and a <= m[2] <= b] for m in marks}
    assert out(spark, small, "callers_innermost") == sorted((*m, min(x)[1]) for m, x in hit.items() if x)
    want = set()
    for m, f, a in marks:
        h = [(k, x, y) for k, g, x, y in spans() if g == f and x <= a + 6 and y >= a]
        want |= {(m, k) for k, x, y in h if not any(j != k and u >= x and v <= y and v - u < y - x for j, u, v in h)}
    assert out(spark, small, "hunk_overlap") == sorted(want)


def test_positions_of_every_row(spark, small, li):
    want = []
    for o, n, _, p in li:
        below = [k for k in range(1, 400) if k * 7 % 90 + 1 == p % 150 + 1 and k <= o]
        want.append((o * 8 + n, p % 150 + 1, o, max(below, default=None), f"n{max(below)}" if below else None))
    assert sorted(map(repr, out_rows(spark, small, "asof_mapping"))) == sorted(map(repr, want))


def out_rows(spark, small, name):
    return [tuple(r) for r in QUERIES[name](spark, small).collect()]


def test_links_of_every_row(spark, small, li):
    links = {(s, p) for _, _, s, p in li}
    of = {s: {p for t, p in links if t == s} for s, _ in links}
    d1 = {s for s in of if 97 in of[s]}
    near = {p for s in d1 for p in of[s]}
    d2 = {s for s in of if of[s] & near} - d1
    want = sorted((s, round((4.0 if s in d1 else 1.5) / (1 + 0.15 * len(of[s])), 6)) for s in d1 | d2)
    assert out(spark, small, "test_selection") == want
    touched = {p for o, _, _, p in li if o % 50 == 1}
    counts = {s: len(of[s] & touched) for s in of}
    assert out(spark, small, "changed_callers") == sorted((s, k) for s, k in counts.items() if k)
