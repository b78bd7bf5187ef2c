"""Shared plumbing of the training-data operators.

Everything here keeps rows distributed: helpers either map whole texts inside
a task, or exchange small fixed-width rows (digests, hashes, ids).
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maps a byte to its lower-case form for A-Z only.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own;
    a cluster must name one, since no folder of one machine is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints/lorekeep"
    return found.rstrip("/")


#: What an Arrow batch may hold, unless the session says otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers; a session's own settings stay."""
    have = spark.conf.getAll
    for k, v in BATCH.items():
        if k not in have:
            spark.conf.set(k, v)


#: Folders of the tables written so far, by scope, innermost last.
_SCOPES: list[list[str]] = [[]]

#: Whether a write drops the files of its own exchanges when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, label: str, scope: int = -1) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage: a lost executor costs no recomputation of what stands
    above. The table goes when the scope it is written in ends, at the latest
    with the driver. The files of the write's exchanges go with the write: no
    later step reads them, and otherwise they stay until the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}/{label}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _SCOPES[scope].append(path.rsplit("/", 1)[0])
    atexit.register(_drop, spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A scope of tables; what it yields writes one that outlives the scope."""
    bounded(spark)
    _SCOPES.append([])
    outer = len(_SCOPES) - 2
    try:
        yield lambda df, label: stash(df, label, outer)
    finally:
        for path in _SCOPES.pop():
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session may have ended first; the folder is temporary anyway
        pass


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like the given one that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidied(run: Callable) -> Callable:
    """A map over batches that gives unused memory back to the system when its task ends.

    Workers stay for later tasks; without this each keeps the most it ever held.
    """

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def columns_as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return bytes_of(batch.column(batch.schema.get_field_index(name)))


def bytes_of(column: pa.Array) -> list[bytes | None]:
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def text_value(column: str, kind: str, setup: Callable[[], Callable[[list[bytes | None]], list]]):
    """A column made of each text's UTF-8 bytes; the rest of the row stays in the JVM.

    setup runs once a task and returns a function of a batch of texts.
    """
    out = arrow_type(T._parse_datatype_string(kind))

    def made(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = setup()
        for texts in columns:
            yield pa.array(fn(bytes_of(texts)), type=out)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(made)(columns)

    return F.arrow_udf(run, kind)(F.col(f"`{column}`"))


def map_texts(df: DataFrame, text_col: str, fields: str, setup: Callable[[], Callable[[bytes | None], tuple]], keep: list[str] | None = None, drop_when: int | None = None) -> DataFrame:
    """Adds the fields (DDL) that a function makes of each text's UTF-8 bytes.

    setup runs once a task and returns the function. keep: columns that stay,
    all by default; one with the name of a new field gives way to it.
    drop_when: index of a boolean new field; rows where it is true go.
    """
    new = T._parse_datatype_string(fields)
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in new.names]
    schema = T.StructType(kept + new.fields)
    bounded(df.sparkSession)
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").alias(fresh("__text", df)))
    arrow_types = [arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in schema.fields]
    n_kept = len(kept)

    def run(batches: Iterable[pa.RecordBatch]):
        fn = setup()
        for batch in batches:
            made = [fn(t) for t in bytes_of(batch.column(n_kept))]
            columns = [batch.column(i) for i in range(n_kept)]
            columns += [pa.array([m[i] for m in made], type=t) for i, t in enumerate(arrow_types)]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            if drop_when is not None:
                out = out.filter(pa.array([not m[drop_when] for m in made], type=pa.bool_()))
            yield out

    return source.mapInArrow(tidied(run), schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}
    return simple[type(kind)]


#: Parts into which the rows of one key are dealt before they are counted.
SALTS = 64


def salt_of(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def repeated_only(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows whose key stands on at least `least` rows, with that count as df.

    Counts combine map-side; a key on very many rows is one row of the counts
    per task. They are written down, so that both sides of the join back are
    plain exchanges and the adaptive planner can split the partition of a
    frequent key.
    """
    counts = stash(rows.groupBy(key).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least), "counts")
    return rows.join(counts.hint("merge"), key)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: rows (node, root), root the smallest node.

    Alternates large-star and small-star steps until nothing changes, which
    takes O(log^2 n) rounds at most: no step makes a link point higher, and
    one that is not the last makes some link point lower. Minima combine
    map-side and are written down before they are joined back, so that both
    sides of such a join are plain exchanges and the adaptive planner can split
    the partition of a node with very many links.
    """
    spark = edges.sparkSession
    with scratch(spark) as keep:
        pairs = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
        while True:
            both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
            large = stash(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
            small_low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "small")
            small = large.join(small_low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            pairs = stash(small_low.select("u", F.col("m").alias("v")).union(small).where("u != v").distinct(), "edges")
            # done when every node points at one root and no root points further
            several = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if several.isEmpty() and pairs.select(F.col("v").alias("u")).distinct().join(pairs.select("u").distinct(), "u").isEmpty():
                break
        nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return keep(nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct()), "components")


# -- filters of a bounded size ---------------------------------------------------

#: Bits a member and most bits of the filter that tells which keys may be in a set; 4 MB of bits when broadcast.
FILTER_SHARE, FILTER_BITS = 12, 1 << 25


def split_by(df: DataFrame, key: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the members', rows whose key surely is not).

    A filter aggregated from all members and broadcast decides without a
    shuffle of df. It has FILTER_SHARE bits for each member as counted, but
    FILTER_BITS at most, so the broadcast is bounded; where members are so
    many that the filter fills up, more rows come through. What it lets
    through wrongly is for the exact join that must follow on the first part.
    """
    own = stash(members.select(F.xxhash64(F.col(f"`{key}`")).alias("x")), "members")
    bits = min(FILTER_BITS, max(1 << 12, 1 << (FILTER_SHARE * own.count()).bit_length()))
    word, bit, mine = (fresh(x, df) for x in ("__word", "__bits", "__place"))
    place = F.pmod(F.col("x"), F.lit(bits))
    set_bits = own.select(F.shiftright(place, 6).cast("int").alias(word), F.pmod(place, F.lit(64)).cast("int").alias("k"))
    words = stash(set_bits.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, k))").alias(bit)), "filter")
    marked = df.withColumn(mine, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(bits))).withColumn(word, F.shiftright(F.col(mine), 6).cast("int")).join(F.broadcast(words), word, "left")
    maybe = F.coalesce(F.expr(f"getbit({bit}, int({mine} & 63)) = 1"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(maybe).select(columns), marked.where(~maybe).select(columns)


# -- hashed words ----------------------------------------------------------------

_WIDE = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256 * _WIDE, np.uint64))
    return _TABLE[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text).

    Words are runs of bytes that are not ASCII white space. A word's hash sums
    a random value for each byte and place; words too long for the table are
    hashed by BLAKE2.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACE[data]
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(~word & before)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    length = ends - starts
    own = data[word].astype(np.int64) * _WIDE
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(own)) - np.repeat(first, length)
    long_words = np.flatnonzero(length > _WIDE)
    if len(long_words):
        place = np.minimum(place, _WIDE - 1)
    hashes = np.add.reduceat(_places()[own + place], first) + length.astype(np.uint64)
    for i in long_words:
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(hashes), counts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words in one stream of word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix64(out)


def chunks(texts: list[bytes | None], size: int = 1 << 18) -> Iterable[list[bytes]]:
    """Texts in order, null as empty, in lists of about `size` bytes or one text."""
    part: list[bytes] = []
    total = 0
    for t in texts:
        part.append(t or b"")
        total += len(part[-1])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part
