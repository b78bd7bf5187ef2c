import hashlib
import random

import pytest

from lorekeep.llm.substrings import dedup_substrings


def brute(rows, width):
    docs = {d: (t or "").encode().split() for d, t in rows}
    seen, out = set(), {}
    for d in sorted(docs, key=lambda d: (d is not None, d)):
        w = docs[d]
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone.update(range(i, i + width))
            seen.add(g)
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def rows_of(rng):
    words = [f"w{i}" for i in range(300)] + ["é", "日本"]
    passages = [rng.choices(words, k=rng.randint(10, 60)) for _ in range(6)]
    texts = [None, "", "a " * 200, "a b " * 100, "x " * 19, "x " * 20, "a " * 30]
    for _ in range(90):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 40))
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += rng.choices(texts, k=20)
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[3])]


@pytest.mark.parametrize(("width", "hot"), [(20, 1000), (20, 1), (7, 5)])
def test_against_brute_force(spark, width, hot):
    rows = rows_of(random.Random(width + hot))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, width=width, hot=hot).collect()}
    assert got == brute(rows, width)


def test_test_documents_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = dedup_substrings(docs.union(docs.limit(3))).collect()
    assert len(out) == len(rows) + 3
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute(rows, 20)


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
