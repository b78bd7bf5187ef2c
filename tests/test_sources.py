from lorekeep.operators.extraction import lock_rows, python_facts
from lorekeep.sources.tree import current, read_segments, walk, write_segment


def test_walk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src/b.py").write_bytes(b"a\0b")
    (tmp_path / "node_modules/c.js").write_text("1")
    rows = walk(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.py"] and rows[0].lines == 3 and rows[0].size == 12


def test_segments(spark, tmp_path):
    store = str(tmp_path / "s")
    for k in range(2):
        write_segment(spark.createDataFrame([(k, "x")], "id int, v string"), store, k)
    assert sorted((r.id, r.segment) for r in read_segments(spark, store).collect()) == [(0, 0), (1, 1)]


def test_store_keeps_whole_generations(spark):
    pages = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("q", 1, 2)], "page string, g int, declared int")
    sections = spark.createDataFrame([("p", 1, "old"), ("p", 2, "a"), ("p", 2, "b"), ("q", 1, "only one"), ("z", 1, "orphan")], "page string, g int, text string")
    assert sorted(r.text for r in current(pages, sections).collect()) == ["a", "b"]


def test_lockfiles():
    assert lock_rows("x/requirements.txt", "Num_Py==1.0\n# c\nq>=2 ; x") == [("pypi", "num-py", "1.0"), ("pypi", "q", "2")]
    assert lock_rows("package-lock.json", "not json") == [] and lock_rows("other", "x") == []


def test_python_facts():
    assert python_facts("def f(:")[0][0] == "syntax_error"
    assert ("function", "f", 1, 2, "Doc.") in python_facts('def f():\n    "Doc."\n')
