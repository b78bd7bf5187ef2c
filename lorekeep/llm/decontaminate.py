"""Benchmark decontamination by Wu-Manber search over word windows.

A text's words are maximal runs of digits, a-z and non-ASCII characters after
lower-casing A-Z. An item's windows are its runs of `width` words; a shorter
item is one window; one without words has none. Null texts have no words.
Repeated items and repeated windows count once per item id; a null item id is
left out. Empty tables on either side give no hits. Rows are independent, so
rows that repeat an id are searched each by its own text, and long texts are
searched whole. The table form returns the id and the results alone, the
filtering form the columns it was given, whatever their names.

The benchmark's size is measured. Where it is over BLOCK_BYTES it is dealt into
blocks, and the documents are searched once for each block: a task holds the
tables of one block only, built once, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import arrow_type, fresh, map_texts, scratch, stash, text_value, tidied

#: Lower-cases A-Z and turns every byte that is in no word into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of benchmark text that one block of tables may hold.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], width: int) -> Iterable[tuple[bytes, ...]]:
    if 0 < len(words) < width:
        return [tuple(words)]
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class WuManber:
    """Multi-pattern search for word sequences of one length.

    Blocks are pairs of words (single words for patterns of one word). The
    shift table says how far the search may move when a block ends here; at
    shift 0 the patterns ending in that block are tested: first by their
    first block, then word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.ends: dict = {}
        b = self.block
        for pattern, items in patterns.items():
            for end in range(b, length + 1):
                key = pattern[end - b : end] if b == 2 else pattern[end - 1]
                move = length - end
                if move < self.shift.get(key, self.default):
                    self.shift[key] = move
            last = pattern[length - b :] if b == 2 else pattern[-1]
            self.ends.setdefault(last, {}).setdefault(pattern[:b], []).append((list(pattern), items))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """(start, items) of every occurrence, by start."""
        n, m, b = len(words), self.length, self.block
        shift, default, ends = self.shift.get, self.default, self.ends
        i = m - 1
        while i < n:
            key = (words[i - 1], words[i]) if b == 2 else words[i]
            move = shift(key, default)
            if move:
                i += move
                continue
            start = i - m + 1
            for pattern, items in ends[key].get(tuple(words[start : start + b]), ()):
                if words[start : i + 1] == pattern:
                    yield start, items
            i += 1


def tables_of(items: list[tuple[str, bytes]], width: int) -> list[WuManber]:
    """One search per window length that occurs."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        for window in set(windows_of(words_of(text), width)):
            by_length.setdefault(len(window), {}).setdefault(window, []).append(item)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


_BUILT: dict = {}


def _tables(block, width: int) -> list[WuManber]:
    """Tables of a broadcast block; a worker keeps those it used last."""
    key = (block.id, width)
    if _BUILT.get("key") != key:
        _BUILT.clear()
        _BUILT.update(key=key, tables=tables_of(block.value, width))
    return _BUILT["tables"]


class _Block:
    """A broadcast with a name that is the same in every worker."""

    def __init__(self, spark, items):
        self.data, self.id = spark.sparkContext.broadcast(items), hashlib.sha256(repr(items).encode()).hexdigest()

    @property
    def value(self):
        return self.data.value


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[_Block]:
    """The benchmark in broadcast blocks, each of about block_bytes at most, one after the other.

    Items are dealt by a hash of their id and text; the driver holds one block
    at a time. An item's windows do not depend on the block it falls in.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield _Block(benchmark.sparkSession, sorted((r.item, r.text.encode()) for r in part.distinct().collect()))


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start: bigint, end: bigint>>"
FOUND = "n_words bigint, item_ids array<string>, hit_spans array<struct<start: bigint, end: bigint>>"


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(s, e) for s, e in merged]


def _search(block: _Block, width: int, text: bytes | None) -> tuple[int, set[str], list[tuple[int, int]]]:
    """(words, items, merged spans) of the block's windows in a text."""
    words = words_of(text)
    items, spans = set(), []
    for search in _tables(block, width):
        for start, found in search.search(words):
            items.update(found)
            spans.append((start, start + search.length))
    return len(words), items, _merged(spans)


def _verdict(n_words: int, items: Iterable[str], spans: list[tuple[int, int]], least_items: int) -> tuple:
    names = sorted(items)
    return (n_words, sum(e - s for s, e in spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= least_items, names, [{"start": s, "end": e} for s, e in spans])


def _search_in_turn(texts: DataFrame, blocks: Iterable[_Block], width: int) -> DataFrame:
    """(key, item_ids, hit_spans) of the texts (key, __text) with hits, block after block.

    A text's key is a hash of it; equal texts have equal hits and count once.
    """
    parts = []
    for block in blocks:

        def setup(block=block):
            def fn(text):
                n, items, spans = _search(block, width, text)
                return n, sorted(items), [{"start": s, "end": e} for s, e in spans]

            return fn

        hits = map_texts(texts, "__text", FOUND, setup, keep=["key"]).where(F.size("item_ids") > 0)
        parts.append(stash(hits.dropDuplicates(["key"]), "hits"))
        block.data.unpersist()
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # one row a block and text
    return union.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[_Block | None, Iterator[_Block]]:
    """(the only block, none) or (none, all blocks)."""
    rest = blocks_of(benchmark, item_col, text_col, block_bytes)
    first = next(rest)
    second = next(rest, None)
    return (first, iter(())) if second is None else (None, chain((first, second), rest))


def _text_key(text_col: str):
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, least_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: word and hit counts, the items found, the hit word spans."""
    only, several = _blocks(benchmark, item_col, item_text_col, block_bytes)
    rows = docs.select(id_col, text_col)
    if only is not None:

        def setup():
            def fn(text):
                return _verdict(*_search(only, width, text), least_items)

            return fn

        return map_texts(rows, text_col, RESULT, setup, keep=[id_col])

    with scratch(docs.sparkSession) as keep:
        texts = rows.select(_text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("__text"))
        hits = keep(_search_in_turn(texts, several, width), "hits")
    counted = map_texts(rows.withColumn("__key", _text_key(text_col)), text_col, "n_words bigint", lambda: lambda text: (len(words_of(text)),), keep=[id_col, "__key"])
    joined = counted.join(hits.hint("merge"), F.col("__key") == F.col("key"), "left").select(id_col, "n_words", "item_ids", "hit_spans")

    def judge(batches):
        for batch in batches:
            out = []
            for n, items, spans in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                out.append(_verdict(n, items or [], _merged((s["start"], s["end"]) for s in spans or []), least_items))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names=names)

    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string(RESULT).fields])
    names, types = schema.names, [arrow_type(f.dataType) for f in schema.fields[1:]]
    return joined.mapInArrow(tidied(judge), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, least_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents holding windows of fewer than least_items items, columns unchanged."""
    only, several = _blocks(benchmark, item_col, item_text_col, block_bytes)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    name = fresh("__hit", docs)
    if only is not None:
        found = text_value(text_col, "boolean", lambda: lambda texts: [len(_search(only, width, t)[1]) >= least_items for t in texts])
        return docs.withColumn(name, found).where(~F.col(name)).select(columns)
    with scratch(docs.sparkSession) as keep:
        texts = docs.select(_text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("__text"))
        gone = keep(_search_in_turn(texts, several, width).where(F.size("item_ids") >= least_items).select(F.col("key").alias(name)), "gone")
    return docs.join(gone.hint("merge"), _text_key(text_col) == F.col(name), "left_anti").select(columns)
