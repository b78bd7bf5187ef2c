import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lorekeep.llm.packing import pack, plan
from lorekeep.llm.tokenize import default_path, encoder

ODD = [None, "", "a", "Hello world. " * 5000, "x" * 50_000, "<|endoftext|> end", "²³ ½ 日本語 😀 ﬁ\x1c\x1d it's ok  \n\n  tab\t'll", "é" * 300 + ". Ça va? " * 10, "x" * 50_000, "a_b __c 12_3 'S don't"]


def test_ids_are_the_tokenizers_own(spark, sf):
    full = Tokenizer.from_file(default_path())
    encode, _ = encoder(default_path())
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, t[:80]


def padded(n):
    return n if n & (n - 1) == 0 else 2048


@pytest.mark.parametrize("block", [1 << 19, 3000])
def test_every_id_once(spark, sf, block):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pack(docs, block=block).collect()
    full = Tokenizer.from_file(default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = room = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total, room = total + at, room + padded(at)
    assert room <= 1.02 * total


def brute(cuts, prices, length):
    from lorekeep.llm.packing import SEQUENCE

    pos, best = [0, *cuts], [0.0]
    for j in range(1, len(pos)):
        costs = [best[i] + (0 if (n := pos[j] - pos[i]) & (n - 1) == 0 else length - n) for i in range(j) if pos[j] - pos[i] <= length]
        best.append(min(costs) + prices[j - 1] + SEQUENCE)
    return best[-1]


def test_plan_is_optimal():
    from lorekeep.llm.packing import SEQUENCE

    rng = np.random.default_rng(1)
    for _ in range(40):
        cuts = np.unique(np.cumsum(rng.integers(1, 30, 60))).tolist()
        prices = rng.integers(0, 9, len(cuts)).astype(float).tolist()
        points = plan(cuts, prices, 64, True)
        price = dict(zip(cuts, prices, strict=True))
        cost = sum((0 if (n := b - a) & (n - 1) == 0 else 64 - n) + price[b] + SEQUENCE for a, b in zip(points, points[1:], strict=False))
        assert points[-1] == cuts[-1] and abs(cost - brute(cuts, prices, 64)) < 1e-9


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, length int")).count() == 0
