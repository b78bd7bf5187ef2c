"""Substring deduplication with suffix automata of reference shards.

A word is covered when it lies in a window of `width` words whose word
sequence also starts earlier: in a document with a smaller id, or in the same
document at an earlier place. Covered words go; windows are judged on the
input.

Reference shards. Each window is owned by its anchor: the smallest hash among
its runs of ANCHOR words. Equal windows have equal anchors, so all
occurrences of a window lie in the shard of its anchor, and anchors that
occur once own nothing that repeats. Only stretches of documents under
repeated anchors reach the shards. In a shard they stream by (document,
start) through a suffix automaton of what came before: the matching
statistics say for each word how long a match ends there; windows whose
match is long enough are removed, and new stretches join the automaton. The
whole reference has no size bound, so an automaton is built where the
shard's stretches meet instead of being broadcast to all documents.

Skew. Documents with equal word sequences form a class, found by salted
counts; all but the first are covered whole. A task drops stretches that it
has itself seen before. Under an anchor on more than HOT places every window
is a shard of its own, so no shard grows with a popular passage.

Null and empty texts have no words. Rows that repeat an id with an equal text
are one document and get equal results; windows at the same id and start are
not earlier than each other. Rows that repeat an id with different texts are
documents of their own: a hash of the text breaks the tie between their ids,
so that one copy of what they share stays. Null ids count as smaller than all
others. An empty table gives an empty result; extra columns are not carried.
Words are compared by 64-bit hashes only to find anchors; windows are compared
word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import chunks, columns_as_bytes, gram_hashes, repeated_only, salt_of, scratch, split_by, stash, tidied, word_hashes

WIDTH = 20
ANCHOR = 8
HOT = 1000
#: Stretches that a task remembers to drop repeats at once.
REMEMBERED = 300_000
NULL_ID = -(1 << 63)


class SuffixAutomaton:
    """Suffix automaton over words that grows and answers as words stream in."""

    __slots__ = ("at", "last", "length", "link", "matched", "next", "separators")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = self.at = self.matched = self.separators = 0

    def begin(self) -> None:
        """A new stretch: no match reaches over its start."""
        self.separators += 1
        self._extend(self.separators)
        self.at = self.matched = 0

    def step(self, word) -> int:
        """Length of the longest match that ends at this word in what came before."""
        v, n = self.at, self.matched
        while v and word not in self.next[v]:
            v = self.link[v]
            n = self.length[v]
        if word in self.next[v]:
            v, n = self.next[v][word], n + 1
        else:
            v = n = 0
        self.at, self.matched = v, n
        return n

    def grow(self, word) -> None:
        self._extend(word)
        # a split may have moved the match to a shorter state
        while self.at and self.matched <= self.length[self.link[self.at]]:
            self.at = self.link[self.at]

    def _extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over all runs of `size` values."""
    done = 1
    out = values
    while done < size:
        step = min(done, size - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of one document."""
    grams = gram_hashes(hashes, min(ANCHOR, width))
    size = width - min(ANCHOR, width) + 1
    return _sliding(grams, size, np.minimum) if len(grams) >= size else np.zeros(0, np.uint64)


def anchor_places(anchors: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchors with one entry for each place at which one stands."""
    if not len(anchors):
        return anchors
    grams = gram_hashes(hashes, min(ANCHOR, width))
    size = width - min(ANCHOR, width) + 1
    edge = np.zeros(size - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, anchors, edge]), size, np.maximum)
    return grams[grams == highest]


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, own, n_words, digest, anchors) of each document."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            n, digests, found = [], [], []
            for part in chunks(columns_as_bytes(batch, "__text")):
                hashes, counts = word_hashes(part)
                at = 0
                for text, k in zip(part, counts.tolist(), strict=True):
                    own = hashes[at : at + k]
                    at += k
                    n.append(k)
                    digests.append(hashlib.sha256(b" ".join(text.split())).digest())
                    found.append(anchor_places(anchors_of(own, width), own, width).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "own", "n_words", "digest", "anchors"])

    return docs.select("doc_id", "own", "__text").mapInArrow(tidied(run), "doc_id bigint, own bigint, n_words bigint, digest binary, anchors array<bigint>")


STRETCH = "shard bigint, doc_id bigint, own bigint, start bigint, stop bigint, words binary"


def _stretches(width: int):
    """Documents with their repeated anchors -> stretches for the shards.

    Rows come by ascending (doc_id, own). A stretch that this task has seen at an
    earlier place needs no shard: its row has no words and says what to remove.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, own, text, anchors, hot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), columns_as_bytes(batch, "__text"), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = (text or b"").split()
                hashes, _ = word_hashes([text or b""])
                owner = anchors_of(hashes, width).view(np.int64)
                wanted = np.isin(owner, np.array(anchors, np.int64))
                single = np.isin(owner, np.array(hot, np.int64)) if hot else np.zeros(len(owner), bool)
                cut = np.ones(len(owner), bool)
                cut[1:] = (owner[1:] != owner[:-1]) | single[1:]
                begins = np.flatnonzero(cut)
                ends = np.append(begins[1:], len(owner))
                for a, b in zip(begins[wanted[begins]].tolist(), ends[wanted[begins]].tolist(), strict=True):
                    stretch = b" ".join(words[a : b + width - 1])
                    key = hashlib.blake2b(stretch, digest_size=16).digest()
                    before = seen.get(key)
                    if before is not None and before < (doc_id, own, a):
                        rows.append((None, doc_id, own, a, b + width - 1, None))
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = (doc_id, own, a)
                    shard = int.from_bytes(key[:8], "little", signed=True) if single[a] else int(owner[a])
                    rows.append((shard, doc_id, own, a, b + width - 1, stretch))
                if len(rows) > 20_000:
                    yield _stretch_batch(rows)
                    rows = []
            if rows:
                yield _stretch_batch(rows)

    return run


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names=["shard", "doc_id", "own", "start", "stop", "words"])


class Shard:
    """Stretches of one shard, in order of (doc_id, own, start)."""

    def __init__(self, width: int):
        self.width = width
        self.automaton: SuffixAutomaton | None = None
        self.first: list[bytes] | None = None  # waits until a second content comes
        self.known: dict[bytes, tuple] = {}

    def covered(self, doc_id: int, own: int, start: int, stretch: bytes) -> list[tuple[int, int]]:
        """Spans of the document, in words, whose windows came earlier."""
        here = (doc_id, own, start)
        before = self.known.get(stretch)
        words = stretch.split(b" ")
        if before is not None:
            return [(start, start + len(words))] if before < here else self._own(start, words)
        self.known[stretch] = here
        if self.first is None:
            self.first = words
            return self._own(start, words)
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
            self._feed(self.first, None)
        return self._feed(words, start)

    def _own(self, start: int, words: list[bytes]) -> list[tuple[int, int]]:
        """What repeats within the stretch itself."""
        if len(words) <= self.width or len(set(words)) == len(words):
            return []
        alone = Shard(self.width)
        alone.automaton = SuffixAutomaton()
        return alone._feed(words, start)

    def _feed(self, words: list[bytes], start: int | None) -> list[tuple[int, int]]:
        sam, width, out = self.automaton, self.width, []
        sam.begin()
        for i, word in enumerate(words):
            if sam.step(word) >= width and start is not None and i + 1 >= width:
                a, b = start + i + 1 - width, start + i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            sam.grow(word)
        return out


def _judge(width: int):
    def run(batches: Iterable[pa.RecordBatch]):
        key, shard = None, None
        for batch in batches:
            rows = []
            for k, doc_id, own, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or k != key:
                    key, shard = k, Shard(width)
                rows += [(doc_id, own, a, b) for a, b in shard.covered(doc_id, own, start, words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "own", "start", "stop"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: What tells documents apart: the id, and among rows of one id a hash of the text.
ROW = ["doc_id", "own"]


def removed_spans(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey, documents covered whole, spans (doc_id, own, start, stop)) of (doc_id, own, __text) rows."""
    survey = stash(_survey(docs, width), "survey")
    keyed = survey.where(F.col("n_words") >= width).select(*ROW, "digest", salt_of(*ROW).alias("salt"))
    parts = keyed.groupBy("digest", "salt").agg(F.min(F.struct(*ROW)).alias("low"), F.max(F.struct(*ROW)).alias("high"))
    classes = parts.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("top"), F.collect_list("salt").alias("salts")).where("first < top")
    dealt = stash(classes.select("digest", "first", F.explode("salts").alias("salt")), "dealt")
    copies = stash(keyed.join(dealt.hint("merge"), ["digest", "salt"]).where(F.struct(*ROW) > F.col("first")).select(*ROW).distinct(), "copies")

    maybe, alone = split_by(survey.select(*ROW, "anchors"), "doc_id", copies)
    once = alone.unionByName(maybe.join(copies, ROW, "left_anti"))
    shared = repeated_only(once.select(*ROW, F.explode("anchors").alias("h")), "h")
    held = stash(shared.groupBy(*ROW).agg(F.collect_set("h").alias("anchors"), F.collect_set(F.when(F.col("df") > hot, F.col("h"))).alias("hot")), "held")

    texts, _ = split_by(docs, "doc_id", held)
    joined = texts.join(held.hint("merge"), ROW).select(*ROW, "__text", "anchors", "hot").sortWithinPartitions(*ROW)
    found = stash(joined.mapInArrow(tidied(_stretches(width)), STRETCH), "stretches")
    shards = found.where("words is not null").select("shard", *ROW, "start", "words").repartition("shard").sortWithinPartitions("shard", *ROW, "start")
    judged = shards.mapInArrow(tidied(_judge(width)), "doc_id bigint, own bigint, start bigint, stop bigint")
    return survey, copies, judged.unionByName(found.where("words is null").select(*ROW, "start", "stop"))


def _cut(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        out = []
        for text, spans in zip(columns_as_bytes(batch, "__text"), batch.column(3).to_pylist(), strict=True):
            words, kept, at, gone = (text or b"").split(), [], 0, 0
            for a, b in merged([(s["start"], s["stop"]) for s in spans]):
                kept += words[at:a]
                gone += b - a
                at = b
            kept += words[at:]
            text = b" ".join(kept)
            out.append((gone, hashlib.sha256(text).hexdigest(), text))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.binary()).cast(pa.string())], names=["doc_id", "own", "n_removed", "kept_sha256", "kept_text"])


EMPTY = hashlib.sha256(b"").hexdigest()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, kept_text.

    kept_text is null where nothing is removed (the text stays as it is).
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"), text.alias("__text"))
    with scratch(docs.sparkSession) as keep:
        survey, copies, spans = removed_spans(rows, width, hot)
        cuts = stash(spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "cuts")
        texts, _ = split_by(rows, "doc_id", cuts)
        cut = texts.join(cuts.hint("merge"), ROW).select(*ROW, "__text", "spans").mapInArrow(tidied(_cut), "doc_id bigint, own bigint, n_removed bigint, kept_sha256 string, kept_text string").dropDuplicates(ROW)
        done = keep(cut.unionByName(copies.select(*ROW, F.lit(None).cast("bigint").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"), F.lit("").alias("kept_text"))), "done")
        base = keep(survey.select(*ROW, "n_words", F.lower(F.hex("digest")).alias("whole")), "base")
    out = base.join(done.hint("merge"), ROW, "left")
    return out.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias(id_col),
        "n_words",
        F.when(F.col("kept_sha256").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        "kept_text",
    )
