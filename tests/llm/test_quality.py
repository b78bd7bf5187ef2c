import zlib

from lorekeep.llm.quality import Model, passages_of, score_quality, train


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    print("held-out accuracy", right, "AUC", auc([(r.score, r.quality) for r in rows]), len(rows))
    assert right > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a" * 100_000, 9), (3, "a" * 100_000, 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (99, 0), (None, 1)], "doc_id long, quality int")
    assert train(docs, one).prior is not None
    model = Model()
    a, b = (model.score(*passages_of([t]))[0] for t in (b"", b"abc def."))
    assert model.score(*passages_of([b"", b"abc def."])).tolist() == [a, b]
    assert score_quality(docs.limit(0), none).count() == 0
