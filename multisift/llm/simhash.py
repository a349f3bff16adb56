"""SimHash near-dedup with pigeonring filtering.

Fingerprints are cut into max_bits + 1 segments in a ring. If two fingerprints differ in at most max_bits bits, then some segment
starts a chain along the ring of which every prefix of l segments differs in at most l * max_bits / segments bits (the
strong pigeonring principle). The first two links of that chain are a join key: one side sends each segment with its
successor, the other also every value within the budget of two segments. The longer prefixes prune what meets at a key, and
only what is left gets the full Hamming check.

Copies share a fingerprint and are one class. What meets at a key is linked by a spanning forest, not by all its pairs: each
member is compared with those not reached yet, in one numpy pass. A key's members are distinct fingerprints that agree in
two segments but for one bit. Of n unrelated fingerprints a key of two segments of 13 and 12 bits expects 14 n / 2^25, which is
compared pair by pair; copies and near copies don't add to that, since a search leaves what it has reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, bucket_of, byte_lengths, chunks, connected_components, free_name, frugal, group_starts, joined_hot, materialise, mixed, packed, spread, unpacked

#: Shingles whose bits are counted at once.
_BLOCK = 100_000
#: Groups at a key up to this size are compared pair by pair in one vector operation, larger ones by a search.
_SMALL = 16


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """A 64-bit SimHash of each text: words in lower case (A-Z only), shingles of `width` words joined by a space, XXH64 with seed 42."""
    text = Text(texts)
    data, bounds = text.normal_form(fold=True)
    whole = data.tobytes()
    lengths = text.ends - text.starts + 1
    starts = np.cumsum(lengths) - lengths
    n = text.n_words
    shingles = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    at = text.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = starts[at]
    last = np.minimum(at + width, text.first[1:][doc]) - 1
    end = starts[last] + lengths[last] - 1
    counts = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(doc), _BLOCK):
        b = min(a + _BLOCK, len(doc))
        h = np.array([digest(whole[i:j], 42) for i, j in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = group_starts(doc[a:b])
        counts[doc[a:b][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    ones = np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(ones).view("<u8").reshape(-1).astype(np.uint64)


class Ring:
    """Segments of 64 bits in a ring, with the keys and budgets of chains."""

    def __init__(self, max_bits: int):
        self.max_bits, self.m = max_bits, max_bits + 1
        edges = [round(64 * k / self.m) for k in range(self.m + 1)]
        self.shift, self.width = edges[:-1], [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
        masks = [((1 << w) - 1) << s for s, w in zip(self.shift, self.width, strict=True)]
        self.budget = [length * max_bits // self.m for length in range(1, self.m + 1)]  # of a chain of 1, 2, ... segments
        self.prefix = []
        for i in range(self.m):
            mask, out = 0, []
            for length in range(1, self.m + 1):
                mask |= masks[(i + length - 1) % self.m]
                out.append(np.uint64(mask))
            self.prefix.append(out)

    def segment(self, x: np.ndarray, i: int) -> np.ndarray:
        return (x >> np.uint64(self.shift[i])) & np.uint64((1 << self.width[i]) - 1)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, fingerprint, role): role 0 for a fingerprint's own chains of two, 1 for chains one bit away in the second."""
        keys, who, role = [], [], []
        for i in range(self.m):
            j = (i + 1) % self.m
            head = mixed(self.segment(x, i) * np.uint64(self.m) + np.uint64(i)) << np.uint64(self.width[j])
            tail = self.segment(x, j)
            # the chain's start is told by the low bits of the key
            for flip in [0, *(1 << b for b in range(self.width[j]))] if self.m > 1 else [0]:
                keys.append(mixed(head + (tail ^ np.uint64(flip))) // np.uint64(self.m) * np.uint64(self.m) + np.uint64(i))
                who.append(x)
                role.append(np.full(len(x), flip != 0, np.uint8))
        keys_, who_, role_ = np.concatenate(keys), np.concatenate(who), np.concatenate(role)
        order = np.argsort(keys_)
        return keys_[order], who_[order], role_[order]

    def linked(self, a: np.ndarray, b: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        """Whether the pairs differ in few enough bits; the chain from segment i prunes first."""
        x = a ^ b
        left = np.arange(len(x))
        for length in range(2, self.m + 1):
            masks = np.array([p[length - 1] for p in self.prefix], np.uint64)[i] if isinstance(i, np.ndarray) else self.prefix[i][length - 1]
            ok = np.bitwise_count(x[left] & (masks[left] if isinstance(i, np.ndarray) else masks)) <= self.budget[length - 1]
            left = left[ok]
        out = np.zeros(len(x), bool)
        out[left] = True
        return out

    def links(self, keys: np.ndarray, who: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among what meets at equal keys, enough to connect all that the keys' chains connect."""
        order = np.lexsort((role, keys))
        keys, who, role = keys[order], who[order], role[order]
        starts = group_starts(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        own = np.add.reduceat(role == 0, starts) if len(starts) else sizes
        found_a, found_b = [], []
        some = np.flatnonzero((own > 0) & (sizes > 1) & (sizes <= _SMALL))
        for g in np.array_split(some, 1 + int((own[some] * sizes[some]).sum()) // 2_000_000):
            left = np.repeat(starts[g], own[g]) + _within(own[g])
            n = np.repeat(sizes[g], own[g])
            a = np.repeat(left, n)
            b = np.repeat(np.repeat(starts[g], own[g]), n) + _within(n)
            ok = who[a] != who[b]
            a, b = a[ok], b[ok]
            ok = self.linked(who[a], who[b], (keys[a] % np.uint64(self.m)).astype(np.int64))
            found_a.append(who[a[ok]])
            found_b.append(who[b[ok]])
        for g in np.flatnonzero((own > 0) & (sizes > _SMALL)).tolist():
            rest = np.unique(who[starts[g] : starts[g] + sizes[g]])
            start = int(keys[starts[g]] % np.uint64(self.m))
            todo: list[int] = []
            while len(rest) or todo:
                if todo:
                    here = np.uint64(todo.pop())
                else:
                    here, rest = rest[0], rest[1:]
                near = self.linked(np.full(len(rest), here), rest, start)
                reached, rest = rest[near], rest[~near]
                found_a.append(np.full(len(reached), here))
                found_b.append(reached)
                todo.extend(reached.tolist())
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): one row for each input row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in chunks(byte_lengths(texts)):
                n = part.stop - part.start
                fp = fingerprints(texts.slice(part.start, n), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, n), pa.array(fp)], ["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(frugal(run), "doc_id long, fp long")


def fingerprint_links(classes: DataFrame, max_bits: int, buckets: int) -> DataFrame:
    """(a, b) over a frame of distinct fingerprints `fp`: links between fingerprints at most max_bits apart, enough to connect them."""
    ring = Ring(max_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(x):
                continue
            keys, who, role = ring.keys(x)
            bounds = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(bounds))
            blobs = [packed(keys[a:b], who[a:b], role[a:b]) for a, b in zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.diff(bounds)[full]), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

    def meet(rows: pa.Table) -> pa.Table:
        got = [unpacked(x, n, "u8", "u8", "u1") for n, x in zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True)]
        a, b = ring.links(*(np.concatenate([g[k] for g in got]) for k in range(3)))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return classes.select("fp").mapInArrow(frugal(send), "bucket long, n long, blob binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """Groups documents whose SimHash fingerprints differ in at most max_bits bits, directly or through others.

    Returns doc_id, fp (signed long) and component_id (the least doc_id of the group), one row for each input row.

    Null, empty and blank texts have fingerprint zero and link like any other; with fewer words than a shingle has, all of them
    are one shingle. Equal fingerprints are in one group. Rows with a null doc_id take part, but name no group: its id is the
    least that is not null, or null if there is none. Repeated rows give repeated rows. Other columns are left out. An
    empty table gives an empty frame.
    """
    prints = materialise(with_fingerprint(docs, words))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = classes.count()
    buckets = max(64, math.ceil(n * 15 * (max_bits + 1) / 1_000_000))
    groups = connected_components(fingerprint_links(classes, max_bits, buckets))
    linked = classes.join(groups.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return joined_hot(prints, named, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, max_bits: int = 6) -> DataFrame:
    """The documents, all columns, but of each group of near duplicates only the one with the least doc_id.

    Repeated rows of that doc_id leave one row. Rows without a doc_id can't be told apart by one and all stay. Names of other columns
    can't clash with those of working columns. An empty table gives an empty frame.
    """
    groups = near_duplicates(docs, words, max_bits)
    return rows_of(docs, materialise(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))))


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of kept(doc_id, n rows), one row each where there are several, and those without a doc_id."""
    name = free_name(docs.columns, "kept_id")

    def of(condition: str) -> DataFrame:
        return docs.join(kept.where(condition).select(F.col("doc_id").alias(name)), F.col("doc_id") == F.col(name), "left_semi")

    out = of("n = 1").unionByName(docs.where("doc_id IS NULL"))
    if kept.where("n > 1").limit(1).count():
        out = out.unionByName(of("n > 1").dropDuplicates(["doc_id"]))
    return out
