"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition, in their order, form one stream of tokens. Cuts
may fall behind a document or behind a sentence. Only a stretch of more than
REACH tokens without such a boundary may also be cut inside, at regular steps
and a higher price. dp[j] is the least cost of a stream cut
at j: padding of every sequence plus the price of its cut, over all cuts i
with j - i within the sequence length. Padding is linear in j - i, so the
minimum over i of dp[i] + i is kept in a monotone queue. Sequences whose
length is a power of two are not padded; those few lengths are tried apart.

A null text is empty: its document is the closing id alone. Repeated ids are
separate documents. An empty table gives no pieces. Columns that clash with
the result's are not carried. A document longer than a block is cut like any
other. Nothing is shuffled: a partition is packed by its own task, and
sequence ids carry the partition's number.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lorekeep.llm.common import columns_as_bytes, tidied
from lorekeep.llm.tokenize import default_path, encoder

LENGTH = 2048
END_ID = 1
#: Prices in tokens: a cut behind a sentence, inside one, and each further sequence.
SENTENCE, INSIDE, SEQUENCE = 2.0, 12.0, 4.0
#: Tokens without a boundary beyond which a stretch may be cut inside, at such steps.
REACH, STEP = 128, 64
#: Tokens that are planned together.
BLOCK = 1 << 19

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def plan(cuts: list[int], prices: list[float], length: int, close: bool) -> list[int]:
    """Cut positions, ascending from 0, of least total cost.

    cuts: allowed positions, ascending, with gaps of at most `length`;
    prices: of each. close: the last cut must be used; otherwise the plan may
    end at any of the cuts within the last `length` tokens.
    """
    pos = [0, *cuts]
    n = len(pos)
    at = {p: i for i, p in enumerate(pos)}
    best, back = [0.0] * n, [0] * n
    queue: deque = deque([(0.0, 0, 0)])  # (dp + position, position, index), values ascending
    powers = [p for p in (1 << k for k in range(12)) if p < length and (p >= 128 or close)]
    small = length & (length - 1) == 0
    for j in range(1, n):
        here = pos[j]
        low = here - length
        while queue[0][1] < low:
            queue.popleft()
        value, p, i = queue[0]
        cost = value + length - here
        if small and p == low:
            cost = best[i]
        for w in powers:
            k = at.get(here - w)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += prices[j - 1] + SEQUENCE
        best[j], back[j] = cost, i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    last = n - 1
    if not close:
        floor = pos[-1] - length
        last = min((k for k in range(n) if pos[k] > floor or k == n - 1), key=lambda k: (best[k] + (SEQUENCE / length) * (pos[-1] - pos[k]), -k))
    out = []
    while last > 0:
        out.append(pos[last])
        last = back[last]
    return [0, *reversed(out)]


class Boundaries:
    """Which tokens end a sentence, and which may begin one."""

    def __init__(self, token_bytes: dict[int, bytes]):
        size = max(token_bytes) + 2
        self.ends, self.begins = np.zeros(size, bool), np.zeros(size, bool)
        for i, b in token_bytes.items():
            text = b.rstrip(b"\"')]")
            self.ends[i] = text.endswith((b".", b"!", b"?", b"\n")) or b"\n" in b
            self.begins[i] = b[:1] in (b" ", b"\n", b"\t", b"\r")

    def sentence_cuts(self, ids: np.ndarray) -> np.ndarray:
        capped = np.minimum(ids, len(self.ends) - 1)
        return np.flatnonzero(self.ends[capped[:-1]] & self.begins[capped[1:]]) + 1


def steps_inside(boundaries: np.ndarray, reach: int = REACH, step: int = STEP) -> np.ndarray:
    """Places inside the stretches between boundaries that are longer than reach."""
    at = np.concatenate(([0], boundaries[boundaries > 0]))
    long = np.flatnonzero(np.diff(at) > reach)
    return np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in long]) if len(long) else np.zeros(0, np.int64)


class Packer:
    """Packs a stream of (doc_id, ids as bytes) into pieces."""

    def __init__(self, bounds: Boundaries, first_sequence: int, length: int, block: int):
        self.bounds, self.sequence, self.length, self.block = bounds, first_sequence, length, block
        self.docs: list[list] = []  # doc_id, bytes not yet emitted, ids before them, all ids
        self.waiting = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        self.docs.append([doc_id, ids, 0, n])
        self.waiting += n
        if self.waiting >= self.block:
            yield from self.flush(False)

    def flush(self, close: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        stream = b"".join(d[1] for d in self.docs)
        ids = np.frombuffer(stream, "<u4")
        ends = np.cumsum([len(d[1]) // 4 for d in self.docs])
        price = np.full(len(ids) + 1, np.inf)
        price[self.bounds.sentence_cuts(ids)] = SENTENCE
        price[ends] = 0.0
        price[steps_inside(np.flatnonzero(np.isfinite(price)))] = INSIDE
        cuts = np.flatnonzero(np.isfinite(price))
        cuts = cuts[cuts > 0]
        points = plan(cuts.tolist(), price[cuts].tolist(), self.length, close)
        doc, doc_start = 0, 0  # position in the stream at which the document's waiting ids begin
        for a, b in zip(points, points[1:], strict=False):
            at = a
            while at < b:
                doc_id, own, before, total = self.docs[doc]
                doc_end = doc_start + len(own) // 4
                stop = min(b, doc_end)
                yield (doc_id, before + at - doc_start, stop - at, zlib.crc32(stream[at * 4 : stop * 4]), total, self.sequence, at - a)
                at = stop
                if at == doc_end:
                    doc, doc_start = doc + 1, doc_end
            self.sequence += 1
        self.waiting = len(ids) - points[-1]
        self.docs = self.docs[doc:]
        if self.waiting:
            used = points[-1] - doc_start
            head = self.docs[0]
            head[1], head[2] = head[1][used * 4 :], head[2] + used


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per piece: where each document's ids lie in which sequence."""
    path = tokenizer_path or default_path()
    close = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]):
        encode, cache = encoder(path)
        packer = Packer(Boundaries(cache.token_bytes), TaskContext.get().partitionId() << 40, length, block)

        def made(rows):
            rows = list(rows)
            for k in range(0, len(rows), 50_000):
                columns = list(zip(*rows[k : k + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, columns_as_bytes(batch, "__text"), strict=True):
                yield from made(packer.add(doc_id, encode((text or b"").decode("utf-8", "replace")) + close))
        yield from made(packer.flush(True))

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as __text").mapInArrow(tidied(run), SCHEMA.replace("doc_id", f"`{id_col}`", 1))
