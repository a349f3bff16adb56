"""Helpers that the operators of this package share.

Text is handled as flat UTF-8 buffers: an Arrow string column becomes one byte array with a space behind every
document, so that word boundaries, word hashes and rolling window hashes are a few numpy passes over the buffer.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy handles at once; a longer document is handled alone.
CHUNK_BYTES = 2_000_000
#: The bytes between words: space, and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
WORD = r"[^\x20\x09-\x0D]+"

_M = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_Q_INV = pow(_Q, -1, 1 << 64)
#: Bytes of words that are hashed at once.
_HASHED = 1 << 15
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and written tables. Where the session names none, a local session (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="multisift-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Runs the plan once and cuts its lineage through a reliable checkpoint."""
    short_batches(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def short_batches(spark: SparkSession, size: int = 8_000_000) -> None:
    """A batch between the engine and Python is in memory several times over: where the session has Spark's default of 64 MB, it gets `size`
    bytes instead."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, f"{size}b")


def spread(df: DataFrame, least_bytes: int = 4_000_000) -> DataFrame:
    """The frame, dealt out anew if there is so little of it that its files would leave cores idle; more than least_bytes a core stays as it is."""
    short_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    hint = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if hint < least_bytes * cores else df


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """About the bytes of text in a frame: twice the planner's size of its files, or a measured sum where that is unknown."""
    hint = int(str(df.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if hint < 1 << 50:
        return 2 * hint
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow whose worker, which lives on idle, gives memory that it no longer uses back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- flat text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


class Text:
    """The words of some documents in one flat buffer.

    data: bytes, each document followed by a space; starts, ends: byte bounds of the words; first: index of each document's
    first word, with the total at the end.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        self.data = whole[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        inside = ~SEPARATOR[self.data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: the sum of a mixed value for each of its bytes and where in the word it stands, mixed again.

        Different salts give independent hashes.
        """
        lengths = self.ends - self.starts
        behind = np.cumsum(lengths)
        out = np.empty(len(lengths), np.uint64)
        a = 0
        while a < len(lengths):  # blocks that stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(behind, behind[a] - lengths[a] + _HASHED, side="right")))
            size = lengths[a:b]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            byte = self.data[np.repeat(self.starts[a:b], size) + place]
            out[a:b] = np.add.reduceat(mixed((place.astype(np.uint64) * np.uint64(256) + byte) * np.uint64(_R) + np.uint64(salt)), first)
            a = b
        return mixed(out + np.uint64(salt))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def normal_form(self, keep: np.ndarray | None = None, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The kept words (all by default), each followed by one space, and each document's byte bounds therein; fold: A-Z to a-z."""
        starts, ends, first = self.starts, self.ends, self.first
        if keep is not None:
            first = np.concatenate([[0], np.cumsum(keep)])[first]
            starts, ends = starts[keep], ends[keep]
        marks = np.zeros(len(self.data) + 1, np.int8)
        marks[starts] += 1
        marks[ends + 1] -= 1
        taken = self.data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
        lengths = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        table_ = np.arange(256, dtype=np.uint8)
        table_[SEPARATOR] = 0x20
        if fold:
            table_[0x41:0x5B] += 0x20
        return table_[taken], lengths[first]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes; runs may cross documents, which the caller masks."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_Q, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(_Q_INV, n)[: n - width + 1])


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive slices of rows whose lengths sum to at most `most`, single rows aside."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total + n > most and i > start:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- packed exchange


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed blob. A first column that is sorted is kept as differences; bytes are laid out by significance."""
    parts = []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x)
        if k == 0 and x.dtype == np.uint64 and len(x):
            x = np.diff(x, prepend=np.uint64(0))
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 0
    for k, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n)
        at += n * width
        out.append(np.cumsum(x, dtype=np.uint64) if k == 0 and kind == "u8" else x)
    return out


def bucket_of(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Range of the space of hashes of 32 bits or more, so that sorted hashes are sorted by bucket too."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a new key begins."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a stream that is sorted by some columns: (key, rows). One group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        edges = [i for i in range(len(rows)) if i == 0 or rows[i] != rows[i - 1]]
        for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
            if held and rows[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = rows[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def joined_hot(many: DataFrame, one: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """many joined to one, which has a row for each key: a key with very many rows is as many keys as there are salts, by a hash of `spread`."""
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


#: Bits of a bitmap of hashed ids, at most: 4 MB.
_BITS = 1 << 25


def id_bitmap(ids: DataFrame) -> DataFrame:
    """One row with the column bits, array<long>: a bitmap of the hashes of the one column of ids (longs), 16 to 32 bits an id, up to _BITS."""
    (name,) = ids.columns
    size = min(_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    place = F.xxhash64(F.col(name).cast("long")).bitwiseAND(F.lit(size - 1))
    words = ids.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return ids.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))}))


def maybe_in(rows: DataFrame, key: Column, bitmap: DataFrame, within: bool = True) -> DataFrame:
    """The rows, all columns, whose key (a long) may be among the ids of the bitmap, which all executors get; or, not within, the others.

    Up to one in sixteen rows that aren't among the ids passes, and more of them where ids are so many that the bitmap is full, so an exact
    join has to follow; what is saved is the shuffle of the others, of which none is among the ids.
    """
    name = free_name(rows.columns, "bits")
    at = F.xxhash64(key).bitwiseAND(F.size(F.col(name)).cast("long") * 64 - 1)
    hit = F.getbit(F.get(F.col(name), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(F.broadcast(bitmap.withColumnRenamed("bits", name)), hit, "left_semi" if within else "left_anti")


# ---------------------------------------------------------------- connected components


#: Salts of a hot key, and nodes of a forest in memory.
_SALTS, _NODES = 16, 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def links() -> pa.RecordBatch:
        found = [(x, r) for x, r in ((x, root(x)) for x in list(parent)) if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > _NODES:  # a forest of what came so far; the next one starts anew
            yield links()
            parent.clear()
    yield links()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge of two long columns; component is the least node it reaches.

    Each task first reduces its edges to a forest. Alternating star steps then join every node to the least neighbour it knows, by
    aggregates and joins only, until nothing changes; the number of rounds grows with the logarithm of the longest path. Null
    or equal ends are no links. Empty input gives an empty frame.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`")
    e = materialise(e.mapInArrow(frugal(_forest), "u long, v long"))
    before = None
    while True:
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == before or not found[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = tuple(found)
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        # a node with very many neighbours is as many keys as there are salts
        salted = both.where("y > x").withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(_SALTS)).cast("int"))
        large = salted.join(least, ["x", "salt"]).select(F.col("y").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(top, "u").where("v > m").select("v", "m").union(top.select("u", "m")).distinct()
        e = materialise(small.toDF("u", "v"))
