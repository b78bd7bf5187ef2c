"""Steps whose tables, exchanges or sorts must not grow beyond their input."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lorekeep.llm import jaccard
from lorekeep.llm.common import stash


def test_signatures_in_slices_are_those_counted_at_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, k % 3 + 1, [rng.randrange(-400, 400) for _ in range(8)]) for k in range(150)]
    reps = spark.createDataFrame(rows, "key bigint, l bigint, signs array<bigint>")
    held = Counter(h for _, _, signs in rows for h in signs)
    want = sorted((k, l, h, held[h]) for k, l, signs in rows for h in signs if held[h] > 1)
    for size in (1 << 26, 200):
        monkeypatch.setattr(jaccard, "SLICE", size)
        assert sorted(map(tuple, jaccard._shared(reps).collect())) == want


def test_a_written_table_leaves_no_exchange_files(spark):
    files = lambda: str(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n"))
    known = set(files().split())
    rows = stash(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counted")
    assert not [f for f in set(files().split()) - known if "/shuffle_" in f]
    assert rows.count() == 10
