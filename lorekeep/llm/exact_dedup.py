"""Exact deduplication on a cuckoo-filter index of live digests.

Null texts count as empty. Texts are equal when their bytes agree after
lower-casing A-Z. Of equal texts the row with the largest id is live; a null
id is smaller than all others. Rows that repeat an id with the same text are
one document listed twice: all of them bear the verdict of that id, and the
filtering form keeps one. An empty table gives an empty result; a long text is
hashed whole. The table form returns the id and the results alone, the
filtering form the columns it was given, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER_AZ, SALTS, fresh, map_texts, salt_of, scratch, split_by, stash, text_value, tidied


class CuckooIndex:
    """Cuckoo filter over live digests with the keys kept beside it.

    The filter holds 16-bit fingerprints in buckets of four, with partial-key
    displacement. A hit is verified against the full digests stored under the
    same fingerprint and bucket pair. When an insertion finds no place in
    max_kicks displacements, the table doubles and is refilled from the
    stored keys.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[tuple[int, int], dict[bytes, list]] = {}
        self.size = self.resizes = self.false_hits = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        return mark, int.from_bytes(digest[2:10], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _maybe(self, mark: int, bucket: int) -> bool:
        return mark in self.table[bucket] or mark in self.table[self._other(bucket, mark)]

    def _key(self, mark: int, bucket: int) -> tuple[int, int]:
        return mark, min(bucket, self._other(bucket, mark))

    def get(self, digest: bytes) -> list | None:
        """What is stored with a live digest; None when it is not live."""
        mark, bucket = self._place(digest)
        if not self._maybe(mark, bucket):
            return None
        found = self.content.get(self._key(mark, bucket), {}).get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, value: list) -> None:
        """Adds a digest that is not live."""
        mark, bucket = self._place(digest)
        self.content.setdefault(self._key(mark, bucket), {})[digest] = value
        self.size += 1
        if not self._settle(mark, bucket):
            self._grow()

    def delete(self, digest: bytes) -> list | None:
        """Takes out a live digest and returns what was stored with it."""
        if self.get(digest) is None:
            return None
        mark, bucket = self._place(digest)
        key = self._key(mark, bucket)
        value = self.content[key].pop(digest)
        if not self.content[key]:
            del self.content[key]
        for b in (bucket, self._other(bucket, mark)):
            if mark in self.table[b]:
                self.table[b].remove(mark)
                break
        self.size -= 1
        return value

    def items(self) -> Iterator[tuple[bytes, list]]:
        for stored in self.content.values():
            yield from stored.items()

    def _settle(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            if len(self.table[b]) < self.SLOTS:
                self.table[b].append(mark)
                return True
        b = bucket
        for kick in range(self.MAX_KICKS):
            slot = self.table[b]
            i = kick % self.SLOTS
            mark, slot[i] = slot[i], mark
            b = self._other(b, mark)
            if len(self.table[b]) < self.SLOTS:
                self.table[b].append(mark)
                return True
        return False

    def _grow(self) -> None:
        keys = list(self.items())
        buckets = (self.mask + 1) * 2
        while True:
            self.mask, self.table, self.content = buckets - 1, [[] for _ in range(buckets)], {}
            self.resizes += 1
            full = True
            for digest, value in keys:
                mark, bucket = self._place(digest)
                self.content.setdefault(self._key(mark, bucket), {})[digest] = value
                full = full and self._settle(mark, bucket)
            if full:
                return
            buckets *= 2


def text_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest): SHA-256 of each text after lower-casing A-Z; null is empty."""
    return map_texts(docs.select(id_col, text_col), text_col, "digest binary", _digest_setup, keep=[id_col])


def _digest(text: bytes | None) -> bytes:
    return hashlib.sha256((text or b"").translate(LOWER_AZ)).digest()


def _digest_setup():
    return lambda text: (_digest(text),)


#: Live digests that one index of a task holds before it is given out.
LIVE = 200_000


def _given(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = [(d, *v) for d, v in index.items()]
    for at in range(0, len(rows), 20_000):
        part = list(zip(*rows[at : at + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.list_(pa.int32()))], names=["digest", "keep_id", "group_size", "salts"])


def _merge(live: int):
    """Runs (digest, top, n, salts) rows, by digest, through an index; one row a live digest.

    A row with a larger id deletes the entry that stood for the digest and
    takes its place. Rows come by digest, so an index of `live` digests is
    complete where the next digest begins: it is given out and a new one
    begun, and a task's memory does not grow with the data.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CuckooIndex(), None
        for batch in batches:
            for digest, top, n, salts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if index.size >= live and digest != last:
                    yield from _given(index)
                    index = CuckooIndex()
                last = digest
                held = index.get(digest)
                if held is None:
                    index.insert(digest, [top, n, list(salts)])
                elif top is not None and (held[0] is None or top > held[0]):
                    index.delete(digest)
                    index.insert(digest, [top, n + held[1], held[2] + list(salts)])
                else:
                    held[1] += n
                    held[2] += salts
        yield from _given(index)

    return run


def live_digests(digests: DataFrame, id_col: str = "doc_id", live: int = LIVE) -> DataFrame:
    """The index's live entries: (digest, salt, keep_id, group_size).

    Rows are first combined per digest and salt, so that a text on a third
    of all rows reaches its bucket as at most SALTS rows.
    """
    parts = digests.groupBy("digest", "salt").agg(F.max(id_col).alias("top"), F.count(F.lit(1)).alias("n"))
    rows = parts.select("digest", "top", "n", F.array("salt").alias("salts")).repartition("digest").sortWithinPartitions("digest")
    found = rows.mapInArrow(tidied(_merge(live)), "digest binary, keep_id bigint, group_size bigint, salts array<int>")
    return found.select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = stash(text_digests(docs, id_col, text_col).withColumn("salt", salt_of(id_col)), "digests")
    live = live_digests(digests, id_col)
    return digests.join(live.hint("merge"), ["digest", "salt"]).select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns.

    Only rows that may go (by a filter of bounded size) are moved; the rest of
    the texts stay where they are.
    """
    with scratch(docs.sparkSession) as keep:
        verdicts = stash(exact_groups(docs, id_col, text_col), "verdicts")
        again = verdicts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
        doubtful = keep(verdicts.where(~F.col("kept")).select(id_col).union(again).distinct(), "doubtful")
        id_name, sha = fresh("__keep", docs), fresh("__sha", docs)
        live = keep(verdicts.where("kept").select(F.col(id_col).alias(id_name), F.col("text_sha256").alias(sha)).distinct(), "live")
    maybe, kept = split_by(docs, id_col, doubtful)
    digest = fresh("__digest", docs)
    marked = maybe.withColumn(digest, text_value(text_col, "binary", lambda: lambda texts: [_digest(t) for t in texts]))
    joined = marked.join(live, marked[id_col].eqNullSafe(live[id_name]) & (F.lower(F.hex(digest)) == F.col(sha)))
    rest = joined.dropDuplicates([id_col, digest]).select([marked[f"`{c}`"] for c in docs.columns])
    return kept.unionByName(rest)


__all__ = ["SALTS", "CuckooIndex", "drop_exact", "exact_groups", "live_digests", "text_digests"]
