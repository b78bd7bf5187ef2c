"""N-gram Jaccard join on a token-group matrix, exact up to 64-bit hashes.

A document's set holds the hashes of its distinct word n-grams (all words as
one when there are fewer). Two documents link when
100 * intersection >= threshold * union.

1. Documents with equal sets form a class, whose key is a hash of the set.
2. A set's n-grams are dealt into parts by ranges of their hashes, in number
   such that linked sets, which differ in few n-grams, agree on several whole
   parts (PartEnum). A part's hash is a signature; the parts of fewest n-grams
   are left out, and so many are dealt that linked sets still share at least l
   signatures. Signatures that no second class holds link nothing: a class with
   too few others is done. Of the rest, the rarest, in number such that linked
   classes share one, partition the classes into groups of candidates. A part
   agrees only where all its n-grams do, so n-grams that many documents of a
   large corpus share by chance make no candidates.
3. In a group, similar classes gather in small cells. The token-group matrix
   holds for each n-gram the cells whose token union has it. Its sum over a
   query's n-grams bounds the overlap with every member of a cell; only cells
   whose bound reaches what a link needs are opened, and their members
   compared exactly. A cell already connected to the query stays shut.
4. A group too large for a task is dealt into blocks by a hash. Links within
   blocks and with the group's best linked classes (its hubs) connect most of
   it. What they leave unconnected is looked at under each rare signature on
   its own: only signatures whose classes lie in several connected parts are
   opened, with a token-group matrix again.

N-grams and classes are told apart by 64-bit hashes (classes of 10^10
documents collide with a chance of about one in a hundred thousand each); all
else is exact. All steps cover all documents; nothing is capped. Null texts
and texts without words have empty sets and link with nothing. Null ids count
as smaller than all others. Rows are documents of their own even where they
repeat an id: each row's component is that of its text. Ties need no rule:
links are symmetric and the smallest id names a component. Empty tables give
empty results. Extra columns are not carried. Ids are integers, or strings
that hold one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER_AZ, chunks, columns_as_bytes, components, fresh, gram_hashes, mix64, salt_of, scratch, split_by, stash, tidied, word_hashes

#: Most classes of a cell.
CELL = 16
#: Stands for a null id; smaller than all others.
NULL_ID = -(1 << 63)


class Tag(NamedTuple):
    """The signatures that sets of low to high n-grams, and smaller ones linked with such, are met by."""

    low: int
    edges: np.ndarray  # least hash of each part but the first
    salts: np.ndarray  # one for each part
    emitted: int
    least: int  # signatures that linked sets share here


class Tags:
    """Size ranges from 1 up, each half as wide again as its start, made as they are needed."""

    def __init__(self, threshold: int):
        self.t, self.made, self.next = threshold, [], 1

    def _more(self) -> None:
        low, high = self.next, self.next * 3 // 2
        differing = 2 * high * (100 - self.t) // (100 + self.t)  # n-grams on one of two linked sets only, at most
        spare, weak = 1 + differing // 16, 1 + differing // 8
        parts = differing + 1 + spare + weak
        edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
        salts = mix64(np.arange(parts, dtype=np.uint64) + np.uint64((len(self.made) + 1) << 40))
        # without a difference linked sets are one class and need no signatures
        self.made.append(Tag(low, edges, salts, parts - weak if differing else 0, 1 + spare))
        self.next = high + 1

    def of(self, n: int) -> list[Tag]:
        """Tags of a set of n n-grams: that of its size and those of all larger sizes it can link with."""
        most = 100 * n // self.t
        while self.next <= most:
            self._more()
        own = bisect_right(self.made, n, key=lambda x: x.low) - 1
        return [x for x in self.made[own : bisect_right(self.made, most, key=lambda x: x.low)] if x.emitted]


def signatures(s: np.ndarray, tags: Tags) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set, and how many of them any linked set has at least.

    With a part agreeing, its size and number agree too. Of the parts on which
    two sets agree, those that come first by size and number are therefore
    left out by neither before as many others are.
    """
    found = tags.of(len(s)) if len(s) else []
    if not found:
        return np.zeros(0, np.uint64), 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)))
    out = []
    for tag in found:
        at = np.concatenate(([0], np.searchsorted(s, tag.edges), [len(s)]))
        kept = np.argsort(at[:-1] - at[1:], kind="stable")[: tag.emitted]
        out.append(mix64((sums[at[1:]] - sums[at[:-1]] + tag.salts)[kept]))
    return np.concatenate(out), found[0].least


def sets_of(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    for part in chunks(texts):
        hashes, counts = word_hashes([t.translate(LOWER_AZ) for t in part])
        grams = gram_hashes(hashes, size)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(grams[at : at + n - size + 1])
            elif n:
                short = hashes[at : at + n]
                yield mix64(np.array([np.dot(short, np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def _with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """(doc_id, n, key, l, signs): set size, hash of the set (null if empty), signatures and how many linked sets share."""

    def run(batches: Iterable[pa.RecordBatch]):
        tags = Tags(threshold)
        for batch in batches:
            n, keys, least, signs = [], [], [], []
            for s in sets_of(columns_as_bytes(batch, "__text"), size):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                own, l = signatures(s, tags)
                least.append(l)
                signs.append(own.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in signs]))).astype(np.int32)
            values = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "n", "key", "l", "signs"])

    return rows.mapInArrow(tidied(run), "doc_id bigint, n bigint, key bigint, l bigint, signs array<bigint>")


def _full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(key, n, grams) of (doc_id, __text) rows."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            made = [(_key(s), len(s), s.tobytes()) for s in sets_of(columns_as_bytes(batch, "__text"), size)]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "n", "grams"])

    return rows.select("doc_id", "__text").mapInArrow(tidied(run), "key bigint, n bigint, grams binary")


class TokenGroups:
    """Cells of similar sets, and the sparse matrix from n-grams to cells.

    Takes the sorted sets of a block; add() puts one after the other, in
    ascending size, into cells. An n-gram on a single set of the block is in
    no overlap and needs no row, unless sets from outside are looked up too
    (outside=True). The matrix is one array: a row has room for as many cells
    as sets hold its n-gram. Memory is a few numbers for each n-gram of the
    block, however many cells there are.
    """

    def __init__(self, threshold: int, sets: list[np.ndarray], outside: bool = False):
        self.t = threshold
        self.size = [len(s) for s in sets]
        self.values, tokens, df = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *self.size])
        if not outside:
            useful = df > 1
            held = useful[tokens]
            tokens, df, self.values = (np.cumsum(useful) - 1)[tokens[held]], df[useful], self.values[useful]
            ends = np.concatenate(([0], np.cumsum(held)))[ends]
        self.tokens = np.split(tokens.astype(np.int32), ends[1:-1])
        self.offset = np.concatenate(([0], np.cumsum(df)))
        self.filled = np.zeros(len(df), np.int64)
        self.row = np.zeros(int(self.offset[-1]), np.int32)
        self.mark = np.zeros(len(df), bool)
        self.parent = list(range(len(sets)))
        self.links = [0] * len(sets)
        self.cells: list[list[int]] = []
        self.union: list[np.ndarray] = []
        self.of_part: dict[int, int] = {}
        self.opened = self.compared = 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.find(i), self.find(j)))
        self.parent[b] = a

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """Per cell, how many of the n-grams its token union holds."""
        n = self.filled[tokens]
        at = np.repeat(self.offset[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.row[at], minlength=len(self.cells))

    def known(self, grams: np.ndarray) -> np.ndarray:
        """The tokens of those n-grams of a set from outside that the block holds."""
        at = np.minimum(np.searchsorted(self.values, grams), max(0, len(self.values) - 1))
        return at[self.values[at] == grams] if len(self.values) else at[:0]

    def linked(self, tokens: np.ndarray, n: int, part: int | None = None) -> Iterator[tuple[int, int]]:
        """(set, cell) of a linked set for each connected part that links with a set of n n-grams.

        part: connected part the set is in already; it is not looked into.
        """
        if not self.cells:
            return
        met = [] if part is None or part not in self.of_part else [self.of_part[part]]
        low = -(-self.t * n // 100)
        bound = self.overlaps(tokens)
        # a linked set has at least `low` n-grams, so a link needs this much in common
        able = np.flatnonzero(bound >= max(1, -(-self.t * (n + low) // (100 + self.t))))
        self.mark[tokens] = True
        for c in able[np.argsort(-bound[able], kind="stable")].tolist():
            cell = self.cells[c]
            if self.find(cell[0]) in {self.find(i) for i in met}:
                continue  # a cell's members are connected
            self.opened += 1
            for other in sorted(cell, key=lambda i: -self.links[i]):
                if self.size[other] < low:
                    continue
                self.compared += 1
                if int(self.mark[self.tokens[other]].sum()) * (100 + self.t) >= self.t * (n + self.size[other]):
                    self.links[other] += 1
                    met.append(other)
                    yield other, c
                    break
        self.mark[tokens] = False

    def add(self, me: int, part: int | None = None) -> list[int]:
        """Puts the next set into a cell it links with, or into a cell of its own; the sets it links with."""
        tokens = self.tokens[me]
        found = list(self.linked(tokens, self.size[me], part))
        self.links[me] = len(found)
        for other, _ in found:
            self.join(me, other)
        if part is not None:
            self.join(me, self.of_part.setdefault(part, me))
        home = next((c for _, c in found if len(self.cells[c]) < CELL), None)
        if home is None:
            home = len(self.cells)
            self.cells.append([])
            self.union.append(tokens)
        else:
            tokens = np.setdiff1d(tokens, self.union[home], assume_unique=True)
            self.union[home] = np.concatenate([self.union[home], tokens])
        self.cells[home].append(me)
        self.row[self.offset[tokens] + self.filled[tokens]] = home
        self.filled[tokens] += 1
        return [other for other, _ in found]


def _in_slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def _grams(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.int64)


def _longs(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _within(threshold: int):
    """Links within each (root, block): rows (key, root, block, sub, links).

    sub is the smallest key of the connected part of the block.
    """

    def settled(at: tuple, keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        groups = TokenGroups(threshold, sets)
        for i in range(len(sets)):
            groups.add(i)
        low: dict[int, int] = {}
        for i, k in enumerate(keys):
            r = groups.find(i)
            low[r] = min(low.get(r, k), k)
        return _longs([(k, *at, low[groups.find(i)], groups.links[i]) for i, k in enumerate(keys)], "key", "root", "block", "sub", "links")

    def run(batches: Iterable[pa.RecordBatch]):
        at, keys, sets = None, [], []
        for root, block, key, stored in _in_slices(batches):
            if (root, block) != at:
                if keys:
                    yield settled(at, keys, sets)
                at, keys, sets = (root, block), [], []
            keys.append(key)
            sets.append(_grams(stored))
        if keys:
            yield settled(at, keys, sets)

    return run


def _with_hubs(threshold: int):
    """Blocks whose hubs come before the members -> links (a, b) of members with hubs."""

    def run(batches: Iterable[pa.RecordBatch]):
        at, hubs, out = None, [], []
        for root, block, member, key, stored in _in_slices(batches):
            if (root, block) != at:
                at, hubs = (root, block), []
            own = _grams(stored)
            if not member:
                hubs.append((key, own))
                continue
            for h, theirs in hubs:
                k = len(np.intersect1d(own, theirs, assume_unique=True))
                if h != key and k * (100 + threshold) >= threshold * (len(own) + len(theirs)):
                    out.append((key, h))
            if len(out) > 50_000:
                yield _longs(out, "a", "b")
                out = []
        yield _longs(out, "a", "b")

    return run


def _across(threshold: int):
    """Classes of one seat, in blocks -> links (a, b) between different parts.

    Rows (whole, seat, block, asks, key, part, grams), the members of a block
    before those that only ask it.
    """

    def built(members: list[tuple], out: list[tuple]) -> TokenGroups:
        groups = TokenGroups(threshold, [m[2] for m in members], outside=True)
        for i, (key, part, _) in enumerate(members):
            out += [(key, members[j][0]) for j in groups.add(i, part)]
        return groups

    def run(batches: Iterable[pa.RecordBatch]):
        at, members, groups, out = None, [], None, []
        for whole, seat, block, asks, key, part, stored in _in_slices(batches):
            if (whole, seat, block) != at:
                if members and groups is None:
                    built(members, out)
                at, members, groups = (whole, seat, block), [], None
            if not asks:
                members.append((key, part, _grams(stored)))
                continue
            groups = groups or built(members, out)
            own = _grams(stored)
            out += [(key, members[j][0]) for j, _ in groups.linked(groups.known(own), len(own), part)]
            if len(out) > 50_000:
                yield _longs(out, "a", "b")
                out = []
        if members and groups is None:
            built(members, out)
        yield _longs(out, "a", "b")

    return run


def _shapes(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(root, seat, blocks, main, moved) of the seats whose classes (root, seat, key, part, bytes) lie in several parts.

    main: the part of most classes; moved: the bytes of sets that go to the
    seat's blocks when all classes sit in one block each and those outside
    the main part ask all others.
    """
    per = rows.groupBy("root", "seat", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("bytes"))
    seats = per.groupBy("root", "seat").agg(F.count(F.lit(1)).alias("parts"), F.sum("bytes").alias("bytes"), F.max(F.struct("k", "part", "bytes")).alias("x")).where("parts > 1")
    blocks = F.ceil(F.col("bytes") / block_bytes).cast("bigint")
    return stash(seats.select("root", "seat", blocks.alias("blocks"), F.col("x.part").alias("main"), (F.col("bytes") + (F.col("bytes") - F.col("x.bytes")) * (blocks - 1)).alias("moved")), "shapes")


def _seats(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(whole, seat, block, asks, key, part): which class sits in or asks which block of which seat."""
    placed = rows.select("seat", "key", "part").join(stash(shapes.select("seat", "blocks", "main", "whole"), "shape").hint("merge"), "seat").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # of two classes in different parts one is not in the main part, and asks all other blocks
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: b != F.col("own"))).alias("block")
    asking = placed.where("part <> main AND blocks > 1").select("whole", "seat", others, F.lit(True).alias("asks"), "key", "part")
    return placed.select("whole", "seat", F.col("own").alias("block"), F.lit(False).alias("asks"), "key", "part").unionByName(asking)


#: Bytes of n-gram hashes that one block of a large group holds, about.
BLOCK_BYTES = 4 << 20
#: Well linked classes of a large group that all its members are compared with first.
HUBS = 16


def _linked_classes(full: DataFrame, rare: DataFrame, threshold: int, block_bytes: int, keep: Callable) -> DataFrame:
    """(key, root): connected classes in the groups of candidates (root, key, n, grams).

    rare: (key, h), the signatures of which linked classes share one.
    """
    sizes = full.groupBy("root").agg(F.sum(F.octet_length("grams")).alias("bytes"))
    large = stash(sizes.where(F.col("bytes") > block_bytes).select("root", F.ceil(F.col("bytes") / block_bytes).cast("bigint").alias("blocks")), "large")
    dealt = full.join(large, "root", "left").withColumn("block", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))))
    rows = dealt.repartition("root", "block").sortWithinPartitions("root", "block", "n", "key").select("root", "block", "key", "grams")
    within = stash(rows.mapInArrow(tidied(_within(threshold)), "key bigint, root bigint, block bigint, sub bigint, links bigint"), "within")
    if large.isEmpty():
        return keep(within.select("key", F.col("sub").alias("root")), "linked")

    inner = within.join(large, "root", "left_anti").select("key", F.col("sub").alias("root"))
    parts = within.join(large, "root")
    best = parts.groupBy("root", "block").agg(F.max(F.struct("links", "key")).alias("x"))
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("x")))
    hub_keys = best.withColumn("k", place).where(F.col("k") <= HUBS).select("root", F.col("x.key").alias("key"))
    big = full.join(large, "root")
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    hubs = big.join(hub_keys, ["root", "key"], "left_semi").select("root", every_block, F.lit(False).alias("member"), "key", "n", "grams")
    held = dealt.where("blocks IS NOT NULL").select("root", "block", F.lit(True).alias("member"), "key", "n", "grams")
    met = hubs.unionByName(held).repartition("root", "block").sortWithinPartitions("root", "block", "member", "n", "key")
    to_hubs = stash(met.select("root", "block", "member", "key", "grams").mapInArrow(tidied(_with_hubs(threshold)), "a bigint, b bigint"), "to_hubs")
    edges = parts.select(F.col("key").alias("a"), F.col("sub").alias("b")).unionByName(to_hubs)
    parted = parts.select("key").join(components(edges), F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("part"))
    parted = stash(parted, "parted")

    # links between parts: looked for under each signature on its own, or in the group as a whole, whichever moves less
    sized = stash(parted.join(big.select("key", "root", "n").hint("merge"), "key").withColumn("bytes", F.col("n") * 8), "sized")
    under = stash(rare.join(sized.hint("merge"), "key").select("root", F.col("h").alias("seat"), "key", "part", "bytes"), "under")
    by_gram, by_group = _shapes(under, block_bytes), _shapes(sized.withColumn("seat", F.col("root")), block_bytes)
    price = lambda shapes, name: shapes.groupBy("root").agg(F.sum("moved").alias(name))
    choice = price(by_group, "whole_moved").join(price(by_gram, "gram_moved"), "root", "left").select("root", (F.col("whole_moved") <= F.coalesce("gram_moved", F.lit(0))).alias("whole"))
    choice = stash(choice, "choice")
    whole = _seats(sized.withColumn("seat", F.col("root")), by_group.join(choice.where("whole"), "root"))
    grams = _seats(under, by_gram.join(choice.where("NOT whole"), "root"))
    seats = stash(whole.unionByName(grams), "seats")
    seated = seats.join(big.select("key", "n", "grams").hint("merge"), "key").repartition("whole", "seat", "block").sortWithinPartitions("whole", "seat", "block", "asks", "n", "key")
    across = stash(seated.select("whole", "seat", "block", "asks", "key", "part", "grams").mapInArrow(tidied(_across(threshold)), "a bigint, b bigint"), "across")
    joined = components(edges.unionByName(across))
    outer = parts.select("key").join(joined, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"))
    return keep(inner.unionByName(outer), "linked")


#: Signatures that are counted at once, about, and most slices they are dealt into.
SLICE, SLICES = 1 << 26, 16


def _shared(reps: DataFrame) -> DataFrame:
    """(key, l, h, df): the signatures of (key, l, signs) that two classes or more hold, df how many.

    Signatures are counted slice by slice: the exchanges of a slice go before
    those of the next are written, and the filter of a slice has few members.
    """
    total = reps.agg(F.sum(F.size("signs").cast("bigint"))).first()[0] or 0
    slices = max(1, min(SLICES, -(-total // SLICE)))
    out = None
    for i in range(slices):
        signed = reps.select("key", "l", F.explode("signs").alias("h")).where(F.pmod("h", F.lit(slices)) == i)
        with scratch(reps.sparkSession) as keep:
            counts = stash(signed.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
            maybe, _ = split_by(signed, "h", counts)
            shared = keep(maybe.join(counts.hint("merge"), "h").select("key", "l", "h", "df"), "shared")
        out = shared if out is None else out.unionByName(shared)
    return out


def _rare(shared: DataFrame) -> DataFrame:
    """(key, h): the rarest signatures of the classes that share enough, in number such that linked classes have one in common."""
    held = shared.groupBy("key").agg(F.first("l").alias("l"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("g")).where(F.size("g") >= F.col("l"))
    return held.select("key", F.explode(F.expr("slice(g, 1, int(size(g) - l + 1))")).alias("x")).select("key", F.col("x.h").alias("h"))


def _groups(rows: DataFrame, size: int, threshold: int, block_bytes: int) -> DataFrame:
    """(doc_id, n, low) of (doc_id, __text) rows: set size and smallest id of the component."""
    with scratch(rows.sparkSession) as keep:
        with scratch(rows.sparkSession) as held:
            # signatures, the largest table, go when the rare ones are found
            sketches = stash(_sketches(rows, size, threshold), "sketches")
            keyed = held(sketches.select("doc_id", "n", "key", salt_of("doc_id").alias("salt")), "keyed")

            # classes of equal sets, salted so that no class meets in one task
            parts = keyed.where("key is not null").groupBy("key", "salt").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("k"))
            classes = held(parts.groupBy("key").agg(F.min("low").alias("low"), F.sum("k").alias("k"), F.collect_list("salt").alias("salts")), "classes")
            maybe, alone = split_by(sketches.where("key is not null").select("key", "l", "signs"), "key", classes.where("k > 1"))
            reps = alone.unionByName(stash(maybe.groupBy("key").agg(F.first("l").alias("l"), F.first("signs").alias("signs")), "reps"))
            rare = held(_rare(_shared(reps)), "rare")

        first = stash(rare.groupBy("h").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "first")
        stars = rare.join(first.hint("merge"), "h").where("key <> a").select("a", F.col("key").alias("b")).distinct()
        members = stash(components(stars).select(F.col("node").alias("key"), "root"), "members")

        # token-group matrix in each group of candidates, one text a class
        chosen = stash(members.join(classes.select("key", "low"), "key").select(F.col("low").alias("doc_id"), "key", "root"), "chosen")
        texts, _ = split_by(rows, "doc_id", chosen)
        full = stash(_full_sets(texts, size).where("n > 0").join(members.hint("merge"), "key").dropDuplicates(["key"]).select("root", "key", "n", "grams"), "full")
        linked = _linked_classes(full, rare, threshold, block_bytes, stash)

        # the smallest id of each component, back to the rows
        lows = stash(linked.join(classes.select("key", "low").hint("merge"), "key"), "lows")
        least_low = stash(lows.groupBy("root").agg(F.min("low").alias("least")), "least")
        named = lows.join(least_low.hint("merge"), "root").select("key", "least")
        dealt = classes.join(named.hint("merge"), "key", "left").select("key", F.explode("salts").alias("salt"), F.coalesce("least", "low").alias("low"))
        out = keyed.join(stash(dealt, "dealt").hint("merge"), ["key", "salt"], "left")
        return keep(out.select("doc_id", "n", F.coalesce("low", "doc_id").alias("low")), "groups")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id. threshold in hundredths."""
    found = _groups(_with_id(docs, id_col, text_col), size, threshold, block_bytes)
    return found.select(F.nullif("doc_id", F.lit(NULL_ID)).alias(id_col), F.col("n").alias("n_shingles"), F.nullif("low", F.lit(NULL_ID)).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of the smallest id of each component stay, with all their columns.

    Rows that repeat an id stay or go together: they go when each of them is
    in the component of a smaller id.
    """
    with scratch(docs.sparkSession) as keep:
        found = _groups(_with_id(docs, id_col, text_col), size, threshold, block_bytes)
        mine = fresh("__id", docs)
        losers = keep(found.groupBy(F.col("doc_id").alias(mine)).agg(F.bool_and(F.col("low") < F.col("doc_id")).alias("goes")).where("goes").select(mine), "losers")
    marked = docs.withColumn(mine, F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)))
    maybe, kept = split_by(marked, mine, losers)
    return kept.unionByName(maybe.join(losers, mine, "left_anti")).select([F.col(f"`{c}`") for c in docs.columns])


__all__ = ["TokenGroups", "drop_near", "near_groups"]
