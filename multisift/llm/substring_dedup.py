"""Substring dedup by fixed-block anchors.

The reference side of the index holds every document's non-overlapping blocks of (window + 1) // 2 words: any run of `window`
words holds at least one whole block of the document it is compared with. Every rolling window of one block length probes
that index. Runs around hits are extended: windows that hold a hit are compared by 96 bits of hash over all their words (two
independent hashes), and windows in a row merge into maximal repeats.

No window is a row. Documents are dealt into batches of some MB; a batch sends its sorted distinct hashes as packed blobs, gets one
bit back for each, and works out the rest from its own text. Documents are shuffled once: all three passes read the same exchange.

Hashes meet in two levels. With n batches, about sqrt(n) of them form a group and the hash space has about sqrt(n) coarse ranges. A batch
sends a blob to each coarse range of its group; there the group's hashes become distinct, and go on to one of about sqrt(n) finer
ranges, where they meet those of the other groups. So a batch sends sqrt(n) blobs, and a task, whether of a coarse or of a fine
range, takes in sqrt(n) blobs in which a hash occurs once, however often the text repeats it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, bucket_of, group_starts, packed, text_bytes, unpacked, windows

_SENT = pa.schema([("part", pa.int64()), ("team", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_UP = pa.schema([("range", pa.int64()), ("team", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_DOWN = pa.schema([("part", pa.int64()), ("team", pa.int64()), ("range", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_BACK = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
_SENT_DDL = "part long, team long, batch long, n long, blob binary"
_UP_DDL = "range long, team long, n long, blob binary"
_DOWN_DDL = "part long, team long, range long, n long, bits binary"
_BACK_DDL = "batch long, part long, n long, bits binary"
_DONE_DDL = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
_LAST = np.iinfo(np.int64).max
#: The second, independent hash of words.
_CHECK = 0x5851F42D4C957F2D


class _Batch:
    """One batch's words, the distinct block hashes among them, and what can be said of its windows."""

    def __init__(self, rows: pa.Table, window: int, block: int, bits: int):
        self.rows, self.window, self.block = rows, window, block
        self.text = Text(rows.column("text").combine_chunks())
        self.ids = np.array([_LAST if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
        self.words = self.text.word_hashes()
        n = self.text.n_words
        doc = self.text.doc_of_word()
        self.left = np.repeat(self.text.first[1:], n) - np.arange(len(doc))  # words from here to the document's end
        self.doc_id, long_enough = self.ids[doc], np.repeat(n >= window, n)
        self.at = np.flatnonzero((self.left >= block) & long_enough)
        hashes = windows(self.words, block)[self.at] >> np.uint64(64 - bits) if len(self.at) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.starts = group_starts(self.sorted)
        self.anchors = self.sorted[self.starts]
        self.place = np.arange(len(doc)) - self.text.first[:-1][doc]

    def anchor_flags(self) -> np.ndarray:
        """Bit 0: an indexed block; bit 1: in two documents."""
        if not len(self.anchors):
            return np.zeros(0, np.uint8)
        at = self.at[self.order]
        ids = self.doc_id[at]
        indexed = np.logical_or.reduceat(self.place[at] % self.block == 0, self.starts)
        several = np.minimum.reduceat(ids, self.starts) != np.maximum.reduceat(ids, self.starts)
        return indexed.astype(np.uint8) | (several.astype(np.uint8) << 1)

    def find_windows(self, shared: np.ndarray) -> None:
        """Windows that hold a shared anchor; their distinct hashes with the least doc_id of each."""
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[self.at[self.order] + 1] = np.repeat(shared, np.diff(np.append(self.starts, len(self.sorted))))
        hits = np.cumsum(hit)
        at = np.flatnonzero(self.left >= self.window)
        self.w_at = at = at[hits[at + self.window - self.block + 1] > hits[at]]
        if not len(at):
            self.w_starts, self.w_hash, self.w_check, self.w_least = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
            self.w_order = np.zeros(0, np.int64)
            return
        hashes = windows(self.words, self.window)[at]
        check = (windows(self.text.word_hashes(_CHECK), self.window)[at] >> np.uint64(32)).astype(np.uint32)
        self.w_order = np.lexsort((check, hashes))
        hashes, check = hashes[self.w_order], check[self.w_order]
        self.w_starts = group_starts(hashes, check)
        self.w_hash, self.w_check = hashes[self.w_starts], check[self.w_starts]
        self.w_least = np.minimum.reduceat(self.doc_id[at[self.w_order]], self.w_starts)

    def finished(self, earlier: np.ndarray) -> pa.Table:
        """earlier: of each distinct window, whether another batch has it in a document before this batch's first."""
        cover = np.zeros(len(self.words) + 1, np.int64)
        if len(self.w_at):
            sizes = np.diff(np.append(self.w_starts, len(self.w_order)))
            at = self.w_at[self.w_order]
            at = at[np.repeat(earlier, sizes) | (self.doc_id[at] > np.repeat(self.w_least, sizes))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        first = self.text.first
        removed_before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = np.diff(removed_before[first])
        data, bounds = self.text.normal_form(~gone)
        whole = data.tobytes()
        kept = [whole[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        spans: list[list] = [[] for _ in kept]
        for d in np.flatnonzero(n_removed).tolist():
            edges = np.flatnonzero(np.diff(gone[first[d] : first[d + 1]].astype(np.int8), prepend=0, append=0)).tolist()
            spans[d] = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
        ids = self.rows.column("doc_id").combine_chunks().cast(pa.int64())
        return pa.Table.from_arrays([ids, pa.array(self.text.n_words), pa.array(n_removed), pa.array(spans, _DONE.field("removed").type), pa.array(kept, pa.string())], schema=_DONE)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _cut(bounds: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(range, number, blob) of each range that isn't empty."""
    return [(k, b - a, packed(*(c[a:b] for c in columns))) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]


def _bits(rows: list[tuple[int, int, bytes]], n: int) -> np.ndarray:
    """The answers of (range, number, bits), in the order of the sorted hashes that were sent."""
    out = [np.unpackbits(np.frombuffer(x, np.uint8), count=m).view(bool) for _, m, x in sorted(rows)]
    found = np.concatenate(out) if out else np.zeros(0, bool)
    if len(found) != n:
        raise ValueError("a batch changed between two passes over it")
    return found


def _lists(rows: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(rows.column(c).to_pylist() for c in names), strict=True))


class _Meeting:
    """What entries of one kind become where they meet: kinds of their columns (the last is the value, the others the key), how the values of
    equal keys combine, and the answer to an entry from its own and the combined value. A yes of a part is a yes of the whole."""

    def __init__(self, kinds: tuple[str, ...], combine: Callable, answer: Callable, coarse: int, fine: int, bits: int):
        self.kinds, self.combine, self.answer, self.coarse, self.fine, self.bits = kinds, combine, answer, coarse, fine, bits

    def sent(self, hashes: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
        return _cut(np.searchsorted(bucket_of(hashes, self.coarse * self.fine, self.bits), np.arange(self.coarse + 1) * self.fine), hashes, *columns)

    def met(self, blobs: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct keys and combined values; each entry's place among them; each entry's own value."""
        got = [unpacked(x, n, *self.kinds) for n, x in blobs]
        columns = [np.concatenate([g[k] for g in got]) for k in range(len(self.kinds))]
        keys, value = columns[:-1], columns[-1]
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        starts = group_starts(*(k[order] for k in keys))
        sizes = np.diff(np.append(starts, len(order)))
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), sizes)
        return [*(k[order][starts] for k in keys), self.combine(value[order], starts, sizes)], place, value

    def resolve(self, sent: DataFrame) -> DataFrame:
        """(batch, part, n, bits): an answer to each entry of each blob. Blobs of parts below 0 come back as they are."""

        def up(key: tuple, rows: pa.Table) -> pa.Table:
            part, team = (k.as_py() for k in key)
            if part < 0:
                return _table([], _UP)
            columns = self.met([x[1:] for x in sorted(_lists(rows, "batch", "n", "blob"))])[0]
            first = part * self.fine
            bounds = np.searchsorted(bucket_of(columns[0], self.coarse * self.fine, self.bits), np.arange(first, first + self.fine + 1))
            return _table([(first + k, team, n, blob) for k, n, blob in _cut(bounds, *columns)], _UP)

        def top(key: tuple, rows: pa.Table) -> pa.Table:
            got = _lists(rows, "team", "n", "blob")
            columns, place, own = self.met([x[1:] for x in got])
            yes, at = self.answer(own, columns[-1][place]), np.cumsum([0, *(n for _, n, _ in got)])
            return _table([(key[0].as_py() // self.fine, team, key[0].as_py(), n, np.packbits(yes[a : a + n]).tobytes()) for (team, n, _), a in zip(got, at[:-1].tolist(), strict=True)], _DOWN)

        def down(key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
            got = sorted(_lists(rows, "batch", "n", "blob"))
            if not got:
                return _table([], _BACK)
            if got and rows.column("part")[0].as_py() < 0:
                return _table([(batch, -1, n, blob) for batch, n, blob in got], _BACK)
            columns, place, own = self.met([x[1:] for x in got])
            yes = _bits(_lists(back, "range", "n", "bits"), len(columns[0]))[place] | self.answer(own, columns[-1][place])
            at = np.cumsum([0, *(n for _, n, _ in got)])
            return _table([(batch, rows.column("part")[0].as_py(), n, np.packbits(yes[a : a + n]).tobytes()) for (batch, n, _), a in zip(got, at[:-1].tolist(), strict=True)], _BACK)

        by_team = sent.groupBy("part", "team")
        above = by_team.applyInArrow(up, _UP_DDL).groupBy("range").applyInArrow(top, _DOWN_DDL)
        return by_team.cogroup(above.groupBy("part", "team")).applyInArrow(down, _BACK_DDL)


def remove_repeats(docs: DataFrame, window: int = 13, batch_bytes: int = 4_000_000, range_bytes: int = 16_000_000, least_batches: int = 96, least_ranges: int = 64) -> DataFrame:
    """Removes each word that a window of `window` words covers whose words also stand in a row in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, removed (ranges of words, end exclusive: the maximal repeats) and kept_text (the kept
    words joined by one space), one row for each input row. Windows are judged on the input, within one document.

    Null text: no words. Documents under `window` words are kept whole. Rows with the same doc_id don't remove each other's
    words. A null doc_id counts as larger than any other, and such rows not as repeats of each other. A very long text is a batch of its
    own. Other columns are left out, whatever their names. An empty table gives an empty frame. Windows are equal if two
    independent hashes of theirs, of 64 and 32 bits, are: at 2e13 windows the chance that any two different ones agree is about 0.3 %.
    """
    block = (window + 1) // 2
    size = text_bytes(docs)
    batches = max(least_batches, math.ceil(size / batch_bytes))
    side = math.ceil(math.sqrt(batches))  # batches of a team, and coarse ranges
    fine = math.ceil(max(least_ranges, size / range_bytes) / side)
    # anchors only propose, so they are as short as leaves one in 256 to chance; windows decide
    bits = min(64, max(32, 8 + math.ceil(math.log2(size + 2))))
    anchors_meet = _Meeting(("u8", "u1"), lambda v, starts, sizes: np.bitwise_or.reduceat(v, starts) | ((sizes > 1).astype(np.uint8) << 1), lambda own, all_: all_ == 3, side, fine, bits)
    windows_meet = _Meeting(("u8", "u4", "i8"), lambda v, starts, sizes: np.minimum.reduceat(v, starts), lambda own, all_: all_ < own, side, fine, 64)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches)))

    def sent(batch: int, parts: list[tuple[int, int, bytes]]) -> list[tuple]:
        return [(part, batch % side, batch, n, blob) for part, n, blob in parts]

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        b = _Batch(rows, window, block, bits)
        return _table(sent(key[0].as_py(), anchors_meet.sent(b.anchors, b.anchor_flags())), _SENT)

    def answers(back: pa.Table, own: bool, n: int) -> np.ndarray:
        return _bits([x for x in _lists(back, "part", "n", "bits") if (x[0] < 0) == own], n)

    def extend(key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _SENT)
        b = _Batch(rows, window, block, bits)
        found = answers(back, False, len(b.anchors))
        b.find_windows(found)
        # the anchors' answers go with the windows to the last pass
        return _table(sent(key[0].as_py(), [(-1, len(found), np.packbits(found).tobytes()), *windows_meet.sent(b.w_hash, b.w_check, b.w_least)]), _SENT)

    def finish(key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _DONE)
        b = _Batch(rows, window, block, bits)
        b.find_windows(answers(back, True, len(b.anchors)))
        return b.finished(answers(back, False, len(b.w_hash)))

    by_batch = dealt.groupBy("batch")
    first = anchors_meet.resolve(by_batch.applyInArrow(anchors, _SENT_DDL))
    second = windows_meet.resolve(by_batch.cogroup(first.groupBy("batch")).applyInArrow(extend, _SENT_DDL))
    return by_batch.cogroup(second.groupBy("batch")).applyInArrow(finish, _DONE_DDL)
