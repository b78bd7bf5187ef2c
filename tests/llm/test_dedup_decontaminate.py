import hashlib
import random

import pytest

from lorekeep.llm.decontaminate import drop_contaminated, find_contamination
from lorekeep.llm.exact_dedup import CuckooIndex, drop_exact, exact_groups


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(3), CuckooIndex(4), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12_000):
        k = rng.choice(keys)
        if k in live:
            assert index.get(k) == [live[k]]
            if rng.random() < 0.4:
                assert index.delete(k) == [live.pop(k)]
        else:
            assert index.get(k) is None and index.delete(k) is None
            index.insert(k, [step])
            live[k] = step
    assert index.resizes and index.size == len(live) and {k: v[0] for k, v in index.items()} == live


def test_cuckoo_index_equal_fingerprints():
    index = CuckooIndex(4)
    keys = [b"\x07\x00" + bytes(8) + i.to_bytes(22, "little") for i in range(8)]
    for k in keys:
        index.insert(k, [k])
    assert all(index.get(k) == [k] for k in keys)
    assert index.get(b"\x07\x00" + bytes(8) + b"\xff" * 22) is None


ROWS = [(5, "Aé"), (9, "aé"), (7, "aÉ"), (1, None), (2, ""), (3, "x" * 300_000), (4, "X" * 300_000), (9, "aé"), (11, "only")]


def test_exact_groups_and_filter(spark):
    df = spark.createDataFrame([(d, t, 0) for d, t in ROWS], "doc_id long, text string, keep_id int").repartition(4)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 9, 3, False), (7, 7, 1, True), (9, 9, 3, True), (9, 9, 3, True), (11, 11, 1, True)]
    kept = drop_exact(df.withColumnRenamed("keep_id", "text_sha256")).withColumnRenamed("text_sha256", "keep_id")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 9, 11]
    assert exact_groups(df.limit(0)).count() == 0 and drop_exact(df.limit(0)).count() == 0


def brute(texts, items, width):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(low))
    wins = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = {}
    for d, t in texts:
        w, hit, found = cut(t), set(), set()
        for win, names in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= names
        s = sorted(found)
        out[d] = (len(w), len(hit), len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), len(s) >= 2)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontaminate_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    words = ["a", "b", "c", "É", "x1", "the"]
    items = [(i, rng.choice([" ", ", "]).join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 8, 9, 14])))) for i in range(25)] + [(30, None), (31, "the the")]
    texts = [(i, " ".join(rng.choices([w.upper() for w in words] + words, k=rng.randint(0, 120)))) for i in range(60)] + [(100, None), (101, ""), (102, "?!"), (103, "a-b.c " * 400)]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, n_hit int")
    bm = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in find_contamination(df, bm, block_bytes=block_bytes).collect()}
    want = brute(texts, items, 8)
    assert got == want
    kept = drop_contaminated(df, bm)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    assert {r.n_items for r in find_contamination(df, bm.limit(0)).collect()} == {0} and find_contamination(df.limit(0), bm).count() == 0
