import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.chat import escape, format_windows, parse, read_back, unescape


@given(st.text(alphabet="<>[]|\\/INSTs y\né", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    out = escape(text)
    assert unescape(out) == text
    for control in ("<|", "</s>", "[INST]", "[/INST]"):
        assert control not in out


ROWS = [(1, i, ("system", "user", "assistant")[i and 1 + i % 2], f"text {i} " + "word " * (i * 37 % 90)) for i in range(60)]
ROWS += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
ROWS += [(2, 0, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "x " * 9000), (2, 2, "user", "<|turn|>a<|end|>\n"), (3, None, "assistant", "<\\|end|>"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 0, "assistant", "é😀")]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(df, **more)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w.over_budget == (w.n_tokens > more.get("budget", 1024))
        assert not w.over_budget or w.n_new == 1
        if w.conv_id == 1 and rows is ROWS:
            assert parse(w.formatted)[0][0] == "system"


def test_round_trip(spark, sf):
    check(spark, ROWS)
    check(spark, ROWS, budget=120, history=40)
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()], budget=200, history=60)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_windows(df)).count() == 0


def test_every_later_window_retains_the_system_turns(spark):
    rows = [(1, 0, "system", "long " * 2000)] + [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 50) for i in range(1, 8)]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 50) for i in range(4)] + [(2, 4, "system", "rule")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 50) for i in range(5, 12)] + [(2, 12, "system", "rule"), (2, 13, "system", "other")] + [(2, i, "user", f"turn {i} " + "word " * 50) for i in range(14, 18)]
    check(spark, rows)
    check(spark, rows, budget=150, history=40)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = {1: [], 2: []}
    for w in sorted(format_windows(df, budget=150, history=40).collect(), key=lambda w: (w.conv_id, w.window_no)):
        turns = parse(w.formatted)
        assert [x for r, x in turns[: w.n_repeated] if r == "system"] == seen[w.conv_id]
        assert w.over_budget or w.conv_id == 2
        seen[w.conv_id] += [x for r, x in turns[w.n_repeated :] if r == "system" and x not in seen[w.conv_id]]
    assert [len(x) for x in seen.values()] == [1, 2]
