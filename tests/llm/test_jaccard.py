import random

import numpy as np
import pytest

from lorekeep.llm import jaccard
from lorekeep.llm.common import components
from lorekeep.llm.jaccard import drop_near, near_groups


def brute(rows, size, threshold):
    sets, low = {}, {}
    for d, t in rows:
        w = [x.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for x in [t or ""]][0].split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        low[d] = d

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    index = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    done = set()
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) in done or find(a) == find(b):
                    continue
                done.add((a, b))
                k = len(sets[a] & sets[b])
                if 100 * k >= threshold * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    low[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def rows_of(rng):
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=12))
    rows = [None, "", "  ", "one", "One", "one two", "a b c", "A b C", "a b c d"]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 150))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w) + rng.choice(["", " " + line]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "threshold", "block_bytes"), [(3, 90, 1 << 22), (5, 80, 1 << 22), (2, 60, 1 << 22), (3, 80, 3000), (2, 60, 1500)])
def test_against_brute_force(spark, size, threshold, block_bytes):
    rows = rows_of(random.Random(size))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, size=size, threshold=threshold, block_bytes=block_bytes).collect()}
    assert got == brute(rows, size, threshold)


@pytest.mark.parametrize("threshold", [60, 80, 90, 99])
def test_linked_sets_share_signatures(threshold):
    rng, tags, checked = np.random.default_rng(threshold), jaccard.Tags(threshold), 0
    for n in [*range(1, 60), *range(60, 2000, 37)]:
        for _ in range(20):
            common, mine, theirs = rng.integers(1, n + 1), rng.integers(0, n // 3 + 2), rng.integers(0, n // 3 + 2)
            if 100 * common < threshold * (common + mine + theirs):
                common = -(-threshold * (mine + theirs) // (100 - threshold))  # just linked
            pool = np.unique(rng.integers(0, 1 << 64, common + mine + theirs, np.uint64, endpoint=False))
            rng.shuffle(pool)
            a, b = np.sort(pool[: common + mine]), np.sort(np.concatenate((pool[:common], pool[common + mine :])))
            if mine + theirs:
                (x, l), (y, m) = jaccard.signatures(a, tags), jaccard.signatures(b, tags)
                assert len(np.intersect1d(x, y)) >= max(l, m)
                checked += 1
    assert checked > 1000


def test_ngrams_shared_by_chance_make_no_candidates(spark, monkeypatch):
    # a large corpus in small: every three-word shingle stands in several unrelated documents
    rng = random.Random(6)
    rows = [" ".join(rng.choices("abcdefghijklmnop", k=300)) for _ in range(200)]
    rows += [rows[i] + " end" for i in range(5)]
    rows = list(enumerate(rows))
    compared, real = [], jaccard._full_sets

    def counted(texts, size):
        compared.append(texts.count())
        return real(texts, size)

    monkeypatch.setattr(jaccard, "_full_sets", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, size=3, threshold=90).collect()}
    assert got == brute(rows, 3, 90)
    assert got[200][1] == 0
    assert compared[0] < 30


def test_test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 5, 80)
    kept = {r.doc_id for r in drop_near(docs).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_empty(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
