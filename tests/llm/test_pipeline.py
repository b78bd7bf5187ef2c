"""The pipeline against brute force, stage by stage, on small documents."""

import random

import corpus_pipeline
from lorekeep.llm.quality import score_quality
from tests.llm.test_jaccard import brute as near_brute


def documents(rng):
    words = [f"word{i}" for i in range(300)]
    text = lambda n: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(n)) + "."
    rows = []
    for i in range(120):
        rows.append((i, " | ".join(rng.choices(words, k=60)) if i % 6 == 0 else text(rng.randint(3, 12))))
    rows += [(200 + i, rows[i][1].upper()) for i in range(1, 12)]
    for i in range(13, 25):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w)))
    leak = " ".join(rng.choices(words, k=12))
    rows += [(400, text(3) + " " + leak + " " + text(2)), (401, None), (402, "")]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows], leak


def test_stages(spark, tmp_path):
    rows, leak = documents(random.Random(2))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / f"out{len(seen)}"))
        docs = spark.read.parquet(str(tmp_path / f"out{len(seen)}"))
        old = {r.doc_id: r.text for r in before.collect()}
        new = {r.doc_id for r in docs.collect()}
        seen.append(name)
        if len(seen) == 1:
            want = {r.doc_id for r in score_quality(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
            junk = {d for d, *_ in rows if d < 120 and d % 6 == 0}
            assert not junk & new
        elif len(seen) == 2:
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            best = {}
            for d, t in old.items():
                k = (t or "").translate(low)
                best[k] = max(best.get(k, d), d)
            want = set(best.values())
        elif len(seen) == 3:
            want = {d for d, (_, c) in near_brute(list(old.items()), 5, 80).items() if c == d}
        elif len(seen) == 4:
            want = {d for d, t in old.items() if leak.lower() not in (t or "").lower()}
            assert 400 in old and 400 not in new
        else:
            want = set(old)
        assert new == want, name
        if len(seen) < 5:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
