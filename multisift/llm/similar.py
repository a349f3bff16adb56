"""Near-dedup by the Jaccard similarity of word shingles: fingerprints and signatures propose, shingle sets decide.

Candidates come from SimHash with pigeonring filtering, and from minima of hashes: 24 bands of 5 minima, of which a pair of similarity
0.8 shares a band with probability 1 - (1 - 0.8^5)^24 = 0.9999. SimHash alone can't propose such pairs: they differ in about 15 % of the
bits, and with so large a budget the segments of the ring are too short to be keys.

Candidates only say which documents have to be looked at together. Each connected set of them gets its shingle sets once, and there
the exact similarity links, by a search that compares a document with those not reached yet in one numpy pass. A set of more than
_MOST members or _BYTES bytes isn't one task: all its members are compared with one of them, in as many tasks as there are salts, and
those that aren't similar to that one are compared with all members in a grid of cells. In a group of near copies the
first step leaves few for the second.

Texts are the bulk of the input, and few of them have to move: a bitmap of hashed ids, of at most 4 MB, tells which rows of the scan
may be members of a set, and at the end which may go. Only those are shuffled, and joined exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, byte_lengths, chunks, connected_components, free_name, frugal, group_starts, grouped, id_bitmap, joined_hot, materialise, maybe_in, mixed, spread, windows
from .simhash import fingerprint_links, fingerprints

_BANDS, _MINIMA = 24, 5
#: The largest set of candidates that is one task, in members and in bytes of shingle hashes; bytes of a side of a cell.
_MOST, _BYTES = 512, 16_000_000
_RNG = np.random.default_rng(8)
_TURN = _RNG.integers(0, 1 << 32, _BANDS * _MINIMA, dtype=np.uint32)
_SPREAD = _RNG.integers(0, 1 << 31, _BANDS * _MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's shingles, sorted within the text, and each text's bounds among them.

    Words in lower case (A-Z only); fewer words than `width` are one shingle.
    """
    text = Text(texts)
    text.data = _FOLD[text.data]
    words, n = text.word_hashes(), text.n_words
    hashes, docs = [], []
    for k in range(1, width + 1):
        of = np.flatnonzero(n >= width) if k == width else np.flatnonzero(n == k)
        if not len(of):
            continue
        count = n[of] - k + 1
        doc = np.repeat(of, count)
        at = text.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        hashes.append(windows(words, k)[at])
        docs.append(doc)
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    doc = np.concatenate([np.zeros(0, np.int64), *docs])
    order = np.lexsort((h, doc))
    first = group_starts(doc[order], h[order])
    h, doc = h[order][first], doc[order][first]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def set_names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 of an empty one."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    names = np.zeros(len(size), np.uint64)
    if len(some):
        names[some] = mixed(np.add.reduceat(mixed(h + np.uint64(1)), bounds[:-1][some]) + size[some].astype(np.uint64))
    return names


def band_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The band keys of each set, a row a set; those of an empty set are of no use."""
    some = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, _BANDS), np.uint64)
    if len(some):
        starts = bounds[:-1][some]
        short = (h >> np.uint64(32)).astype(np.uint32)
        for band in range(_BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * _MINIMA, (band + 1) * _MINIMA):
                key = mixed((key << np.uint64(32)) ^ (key >> np.uint64(32)) ^ np.minimum.reduceat((short ^ _TURN[k]) * _SPREAD[k], starts))
            keys[some, band] = key
    return keys


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each of some distinct sets that aren't empty, the number of its group: sets of that similarity are in one, directly or through others."""
    size = np.array([*map(len, sets)])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    of, group, mark = np.full(len(sets), -1), 0, np.zeros(len(values), bool)
    rest, left, todo = np.arange(len(sets)), flat, []
    while len(rest):
        if not todo:
            of[rest[0]] = group
            group += 1
            todo, left, rest = [int(rest[0])], left[size[rest[0]] :], rest[1:]
            continue
        here = todo.pop()
        own = flat[starts[here] : starts[here] + size[here]]
        mark[own] = True
        n = size[rest]
        shared = np.add.reduceat(mark[left], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        near = shared >= least * (n + size[here] - shared) - 1e-9
        if near.any():
            of[rest[near]] = of[here]
            todo.extend(rest[near].tolist())
            left, rest = left[np.repeat(~near, n)], rest[~near]
    return of


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, name, size, fp, keys): name and size of the shingle set, SimHash fingerprint and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(byte_lengths(batch.column(1))):
                n = part.stop - part.start
                texts = batch.column(1).slice(part.start, n)
                h, at = shingle_sets(texts, width)
                names, keys = set_names(h, at), band_keys(h, at)
                bounds = pa.array(np.arange(n + 1, dtype=np.int32) * _BANDS)
                lists = pa.ListArray.from_arrays(bounds, pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(names.view(np.int64)), pa.array(np.diff(at)), pa.array(fingerprints(texts, width).view(np.int64)), lists], ["doc_id", "name", "size", "fp", "keys"])

    return spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(frugal(run), "doc_id long, name long, size long, fp long, keys array<long>")


def candidates(classes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) over distinct sets (name, fp, keys): links enough to connect what shares a band or is within max_bits bits."""
    bands = classes.where("name <> 0").select("name", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.min("name").alias("head"), F.max("name").alias("last")).where("head < last").select("key", "head")
    out = joined_hot(bands, heads, ["key"], "name").where("name <> head").select("name", "head").distinct()
    prints = materialise(classes.where("name <> 0").groupBy("fp").agg(F.min("name").alias("head")))
    buckets = max(64, math.ceil(prints.count() * 15 * (max_bits + 1) / 1_000_000))
    links = fingerprint_links(prints, max_bits, buckets)
    for end in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}")), end)
    same = joined_hot(classes.where("name <> 0").select("name", "fp"), prints, ["fp"], "name").where("name <> head").select("name", "head")
    return out.union(same).union(links.select("head_a", "head_b")).toDF("a", "b")


def keep_similar(docs: DataFrame, words: int = 5, least: float = 0.8, max_bits: int = 6) -> DataFrame:
    """The documents, all columns, but of those whose shingle sets have a Jaccard similarity of at least `least`, directly or through
    others, only the one with the least doc_id.

    Texts without words, null ones among them, are alike. Repeated rows of that doc_id leave one row. Rows without a doc_id all stay and
    link nothing. Names of other columns can't clash. An empty table gives an empty frame. Similarities are exact but for equal
    hashes of 64 bits; of pairs at 0.8, one in 10,000 is expected not to become a candidate.
    """
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(described(plain, words))
    classes = materialise(rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    parts = connected_components(candidates(classes, max_bits))
    asked = classes.join(parts, F.col("name") == F.col("node")).select("name", "least", "component", "size")
    sizes = asked.groupBy("component").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes"), F.min("name").alias("head"))
    asked = materialise(joined_hot(asked, sizes, ["component"], "name"))
    large = (F.col("n") > _MOST) | (F.col("bytes") > _BYTES)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for part in chunks(byte_lengths(texts)):
                n = part.stop - part.start
                h, bounds = shingle_sets(texts.slice(part.start, n), words)
                blobs = pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                of = batch.slice(part.start, n)
                # rows of one doc_id may have several texts: those of the member stay
                own = pa.array(set_names(h, bounds).view(np.int64) == of.column("name").to_numpy())
                yield pa.RecordBatch.from_arrays([*of.columns[1:], blobs], [*of.schema.names[1:], "hashes"]).filter(own)

    def held(members: DataFrame) -> DataFrame:
        """The members with their shingle sets."""
        texts = maybe_in(plain, F.col("doc_id"), id_bitmap(members.select("least"))).join(members, F.col("doc_id") == F.col("least")).select("text", *members.columns)
        return texts.mapInArrow(frugal(sets), ", ".join(f"{c} {t}" for c, t in members.dtypes) + ", hashes binary")

    def found(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, their least doc_id and the number of each one's group."""
        by_name = dict(zip(table.column("name").to_pylist(), zip(table.column("least").to_pylist(), table.column("hashes").to_pylist(), strict=True), strict=True))
        return np.array(list(by_name), np.int64), np.array([x for x, _ in by_name.values()], np.int64), similar_groups([np.frombuffer(x, np.uint64) for _, x in by_name.values()], least)

    def meet(table: pa.Table) -> pa.Table:
        _, first, of = found(table)
        head = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(head, of, first)
        return pa.table({"doc_id": first[first != head[of]]})

    gone = held(asked.where(~large)).groupBy("component").applyInArrow(meet, "doc_id long")
    if asked.where(large).limit(1).count():
        gone = gone.union(_of_large(materialise(held(asked.where(large)).dropDuplicates(["name"])), least, found))
    kept = classes.select(F.col("least").alias("doc_id")).join(gone, "doc_id", "left_anti").distinct().withColumn("kept", F.lit(True))
    fates = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left")
    return _without(docs, materialise(fates.where("kept IS NULL OR n > 1")))


def _without(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """The documents but for odd(doc_id, n rows, kept), of which one row of each stays where kept is true. Those without a doc_id stay."""
    name = free_name(docs.columns, "odd_id")
    key = F.col("doc_id").cast("long")
    ids = odd.select("doc_id")
    bitmap = id_bitmap(ids)
    maybe = maybe_in(docs, key, bitmap)
    out = maybe_in(docs.where(key.isNotNull()), key, bitmap, False).unionByName(docs.where("doc_id IS NULL"))
    out = out.unionByName(maybe.where(key.isNotNull()).join(ids.select(F.col("doc_id").alias(name)), key == F.col(name), "left_anti"))
    several = odd.where("kept")
    if several.limit(1).count():
        out = out.unionByName(maybe.join(several.select(F.col("doc_id").alias(name)), key == F.col(name), "left_semi").dropDuplicates(["doc_id"]))
    return out


def _of_large(members: DataFrame, least: float, found: Callable) -> DataFrame:
    """The doc_ids that go among large sets of candidates: members has name, least, component, n, bytes, head and hashes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("hashes"), batch.column("head_hashes"), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared >= least * (len(a) + len(b) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("name"), batch.column("head"), pa.array(near, pa.bool_())], ["component", "name", "head", "near"])

    heads = members.where("name = head").select("component", F.col("hashes").alias("head_hashes"))
    to_head = joined_hot(members, heads, ["component"], "name").select("component", "name", "head", "hashes", "head_hashes")
    to_head = materialise(to_head.mapInArrow(frugal(compare), "component long, name long, head long, near boolean"))
    rest = to_head.where("NOT near").groupBy("component").agg(F.count("*").alias("left"))
    # the others of a component against all of it; a side of a cell has about _BYTES / 4 bytes, and _MOST / 2 members at most
    per = F.greatest(F.lit(1), F.least(F.lit(_MOST // 2), F.floor(F.col("n") * (_BYTES // 4) / F.col("bytes")))).cast("long")
    every = joined_hot(members, rest, ["component"], "name").withColumn("rows", F.ceil(F.col("left") / per)).withColumn("columns", F.ceil(F.col("n") / per))
    other = every.join(to_head.where("NOT near").select("name"), "name", "left_semi")
    row, column = F.pmod(F.xxhash64("name"), F.col("rows")), F.pmod(F.xxhash64("name", F.lit(1)), F.col("columns"))
    wanted = ("component", "i", "j", "name", "least", "hashes")
    cells = other.withColumn("i", row).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).select(*wanted)
    cells = cells.unionByName(every.withColumn("j", column).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select(*wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in grouped(batches, ["component", "i", "j"]):
            names, _, of = found(cell)
            first = names[np.unique(of, return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(first[of])], ["a", "b"])

    links = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(frugal(search), "a long, b long")
    # dealt out, so that a task has one Python worker: the next step's function would take a second one beside that of the cells
    links = links.where("a <> b").repartition("a")
    groups = connected_components(links.union(to_head.where("near").select("name", "head")).where("a <> b"))
    grouped_ = groups.join(members.select(F.col("name").alias("node"), "least"), "node")
    firsts = grouped_.groupBy("component").agg(F.min("least").alias("first"))
    return joined_hot(grouped_, firsts, ["component"], "node").where("least <> first").select(F.col("least").alias("doc_id"))
