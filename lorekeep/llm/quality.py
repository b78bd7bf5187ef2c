"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages (blocks of PASSAGE bytes of its whole text).
Every passage is encoded by the shares of its byte classes and of the
transitions between them, through a learned layer; gated attention weights
(tanh times sigmoid) learned from document labels alone say how much each
passage counts, and the weighted passage representation is scored.

Training uses a bounded sample of labelled rows: TRAIN_DOCS rows at most in
the order of a hash of their id, as long as all their passages together are
TRAIN_PASSAGES at most. A row is taken with every passage of its text or not
at all. Scoring reads every passage of every text. Labels, ids and other
columns are never inputs of a score.

Null and empty texts are one passage without bytes and get its score. Null
labels and labels of unknown documents are left out; of several labels of a
document the mean counts. Without labels, or with one class only, the score
is the share of that class (0.5 without any). Repeated rows get equal
scores; rows that repeat an id with different texts are scored each by its
own text. Null ids are scored, but bear no label. An empty table gives none.
The filtering form returns the columns it was given, whatever their names; a
long text is one row of many passages and is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import columns_as_bytes, fresh, stash, text_value, tidied

PASSAGE = 512
TRAIN_DOCS, TRAIN_PASSAGES = 3000, 60_000
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY, SEED = 60, 0.01, 1e-4, 7

#: Byte classes: lower, upper, digit, space, newline, full stop, comma, other sentence marks, quotes and brackets, symbols, control, non-ASCII.
CLASSES = 12


def _class_table() -> np.ndarray:
    table = np.full(256, 9, np.uint8)
    table[:32], table[127], table[128:] = 10, 10, 11
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".", 5), (",", 6), ("!?;:", 7), ("\"'()[]{}", 8)):
        for c in chars:
            table[ord(c)] = kind
    return table


TABLE = _class_table()
DIM = CLASSES + CLASSES * CLASSES


def passages_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    classes = TABLE[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
    total = int(counts.sum())
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc_at = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    own = (np.repeat(first, sizes) + (np.arange(len(classes)) - doc_at) // PASSAGE).astype(np.int32)
    del doc_at
    single = np.bincount(own * CLASSES + classes, minlength=total * CLASSES).reshape(total, CLASSES)
    same = own[1:] == own[:-1]
    code = own[1:] * (CLASSES * CLASSES) + classes[:-1] * CLASSES + classes[1:]
    pairs = np.bincount(code[same], minlength=total * CLASSES * CLASSES).reshape(total, CLASSES * CLASSES)
    x = np.concatenate([single, pairs], axis=1).astype(np.float32)
    x /= np.maximum(1, single.sum(axis=1, keepdims=True))
    return np.sqrt(x), counts


class Model:
    """Weights of the encoder, the attention and the score."""

    SHAPES = {"w": (DIM, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}

    def __init__(self, seed: int = SEED, prior: float | None = None):
        rng = np.random.default_rng(seed)
        self.prior = prior
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else rng.normal(0, 0.1, s)).astype(np.float64) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(DIM), np.ones(DIM)

    def forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        attention = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return h, t, g, attention, z, z @ p["c"] + p["d"][0]

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(counts), self.prior)
        if not len(counts):
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        return 1 / (1 + np.exp(-np.clip(self.forward(x, starts, counts)[-1], -30, 30)))

    def gradients(self, x, starts, counts, y):
        p = self.p
        h, t, g, att, z, out = self.forward(x, starts, counts)
        d_out = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        grads = {"c": z.T @ d_out, "d": np.array([d_out.sum()])}
        d_z = np.repeat(d_out[:, None] * p["c"], counts, axis=0)
        d_h = att[:, None] * d_z
        d_att = (d_z * h).sum(axis=1)
        d_e = att * (d_att - np.repeat(np.add.reduceat(att * d_att, starts), counts))
        grads["a"] = (t * g).T @ d_e
        d_tg = d_e[:, None] * p["a"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        grads["v"], grads["u"] = h.T @ d_t, h.T @ d_g
        d_h = (d_h + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - h * h)
        grads["w"], grads["b"] = ((x - self.mean) / self.scale).T @ d_h, d_h.sum(axis=0)
        return grads

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> Model:
        """Adam over mini-batches of whole bags."""
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 0.02
        rng, m, v, step = np.random.default_rng(SEED), {}, {}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                counts = np.array([len(bags[i]) for i in part])
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in part]), starts, counts, labels[part]).items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out_column(id_col: str):
    """Whether crc32 of the id as text is divisible by five."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES) -> Model:
    """Fits the model on the bounded sample; held-out rows are never read for it."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out_column(id_col))
    chosen = rows.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    # at most `limit` rows of two numbers: a broadcast of proven size
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("__text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(batch.num_rows):
                x, _ = passages_of(columns_as_bytes(batch.slice(at, 1), "__text"))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1) for c in batch.columns[:2]), batch.column(3).slice(at, 1), pa.array([len(x)], pa.int64()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["id", "text_key", "label", "n", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())])
    held = stash(sample.select("id", "text_key", "__text", "label").mapInArrow(tidied(run), schema), "sample")
    sizes = held.select("id", "text_key", "n").distinct().orderBy(F.xxhash64("id"), "id", "text_key").limit(limit).collect()
    took, total = [], 0
    for r in sizes:
        if total + r.n <= passages:
            took.append((r.id, r.text_key))
            total += r.n
    if not took:
        return Model(prior=0.5)
    picks = docs.sparkSession.createDataFrame(took, T.StructType([schema["id"], schema["text_key"]]))
    got = held.join(F.broadcast(picks), ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("id", "text_key", "label", "x").collect()
    got.sort(key=lambda r: (str(r.id), r.text_key))
    y = np.array([r.label for r in got])
    if y.min() == y.max():
        return Model(prior=float(y.mean()))
    return Model().fit([np.frombuffer(r.x, "<f4").reshape(-1, DIM) for r in got], y)


#: Bytes of text whose passages are encoded together.
CHUNK = 1 << 19


def _scores(model: Model, texts: list[bytes | None]) -> list[float]:
    out, part, size = [], [], 0
    for text in [*texts, None]:
        if len(out) + len(part) == len(texts) or size > CHUNK:
            if part:
                out += model.score(*passages_of(part)).tolist()
            part, size = [], 0
        part.append(text or b"")
        size += len(part[-1])
    return out


def score_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """The score of each text, as a column; only texts and scores pass through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return text_value(text_col, "double", lambda: lambda texts: _scores(shared.value, texts))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(f"`{id_col}`"), score_column(docs, model, text_col).alias("score"))
    return scored.select(id_col, held_out_column(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted 1, with their columns."""
    name = fresh("__score", docs)
    scored = docs.withColumn(name, score_column(docs, train(docs, labels, id_col, text_col), text_col))
    return scored.where(F.col(name) >= threshold).select([F.col(f"`{c}`") for c in docs.columns])
