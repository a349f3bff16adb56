"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search keeps, for each boundary within one longest piece of the end, the best piece that ends there and where it began. From
time to time all these backpointer paths are followed back; the ids before the boundary in which they have met are committed
and forgotten, so memory is bounded by the window and not by the text.

A unigram model's path is that of the highest total score. A BPE model has one valid path to each boundary: a piece continues
it only if merging the last two pieces anew, by the model's own order of merges, leaves the boundary between them. That is
the same search with a yes or no in place of a score, and gives the ids of merging the whole text. Characters outside the vocabulary
become byte pieces.

At a boundary that no piece can cross (between a character and a following space) all paths meet, so a text is searched run by run.
A BPE model's runs go through the search side by side in lanes: each lane keeps a ring of boundaries a few longest pieces wide, and
every longest piece's length the lanes' paths are followed back together and what they agree on is committed. Very long runs, and lanes
whose paths don't meet within the ring, are searched one at a time by the same rule. A run that occurred in the chunk before isn't
searched again.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, chunks, frugal, spread

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Values fixed by the format of model files.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bounds: pairs of pieces remembered, lanes searched at once, the longest run in a lane, a lane's ring in longest pieces, and the text
#: encoded at once.
_PAIRS, _AT_ONCE, _LANE, _RING, _CHARS = 300_000, 20_000, 128, 4, 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, data[at : at + size]
        at += size


class Table:
    """A map of non-negative integers for many keys at once: open addressing, cleared when it is half full."""

    def __init__(self, size: int, kind: type = np.int64):
        self.bits, self.kind = max(10, (4 * size).bit_length()), kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, self.kind), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        slot, out = self._slots(keys), np.full(len(keys), -1, np.int64)
        rows = np.arange(len(keys))
        while len(rows):
            there = self.keys[slot[rows]]
            hit = there == keys[rows]
            out[rows[hit]] = self.values[slot[rows[hit]]]
            rows = rows[~hit & (there >= 0)]
            slot[rows] = (slot[rows] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not in the map and differ from each other; of more than fill half of it, the first."""
        keys, values = keys[: 1 << self.bits - 1], values[: 1 << self.bits - 1]
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            self.clear()
        self.used += len(keys)
        slot, rows = self._slots(keys), np.arange(len(keys))
        while len(rows):
            free = self.keys[slot[rows]] < 0
            self.keys[slot[rows[free]]] = keys[rows[free]]  # of several for one slot the last stays
            won = self.keys[slot[rows]] == keys[rows]
            self.values[slot[rows[won]]] = values[rows[won]]
            rows = rows[~won]
            slot[rows] = (slot[rows] + 1) & ((1 << self.bits) - 1)


class Model:
    """Pieces, scores and types of a model file, and its search."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap or self.squeeze or USER_DEFINED in self.types:
            raise ValueError("only unigram and BPE models without text normalisation and user-defined pieces are read")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.runs = re.compile(".+", re.DOTALL) if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.worst = min(self.scores, default=0.0) - 10
        # a tree of the pieces' characters: (node << 21 | character) -> node, and the piece that ends at a node
        self.next: dict[int, int] = {}
        self.piece = [-1]
        for text, i in self.ids.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in self.next:
                    self.next[key] = len(self.piece)
                    self.piece.append(-1)
                node = self.next[key]
            self.piece[node] = i
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else " \u2047 ".encode() if t == UNKNOWN else b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self._tree = Table(len(self.next))
        self._tree.put(np.fromiter(self.next, np.int64, len(self.next)), np.fromiter(self.next.values(), np.int64, len(self.next)))
        self._piece_at = np.array(self.piece, np.int64)
        self._pairs = Table(_PAIRS, np.int8)
        self._stays: dict[int, bool] = {}
        self._before: dict[str, bytes] = {}  # the runs of the last chunk

    # ------------------------------------------------ merges

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the adjacent pair with the highest score merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging two pieces' text anew gives just these two; a left of -1 stands for none, or one that never merges."""
        key = (left + 1) << 32 | right
        known = self._stays.get(key)
        if known is None:
            if len(self._stays) > _PAIRS:
                self._stays.clear()
            known = self._stays[key] = self._unmerged(left, right)
        return known

    def _unmerged(self, left: int, right: int) -> bool:
        parts = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
        return self.merged("".join(parts)) == parts

    # ------------------------------------------------ search

    def search(self, text: str, window: int = 4) -> Iterator[tuple[int, int, int]]:
        """(begin, end, id) of the pieces of a text, committed as soon as all paths that may still grow have met.

        A character outside the vocabulary is a piece of its own with id -1.
        """
        return (self._by_merges if self.kind == BPE else self._by_scores)(text, window * self.longest)

    def _by_scores(self, text: str, window: int) -> Iterator[tuple[int, int, int]]:
        n, step, done = len(text), self.next, 0
        last, value = {0: (0, -1)}, {0: 0.0}  # of each boundary: length and id of the best piece that ends there, and the total
        for begin in range(n):
            if begin not in last:
                continue
            node = 0
            for end in range(begin, n):
                node = step.get(node << 21 | ord(text[end]))
                if node is None:
                    break
                i = self.piece[node]
                if i >= 0:
                    total = value[begin] + self.scores[i]
                    if end + 1 not in last or total > value[end + 1]:
                        last[end + 1], value[end + 1] = (end + 1 - begin, i), total
            if begin + 1 not in last and ord(text[begin]) not in step:
                last[begin + 1], value[begin + 1] = (1, -1), value[begin] + self.worst
            if begin + 1 - done >= window and begin + 1 < n:
                met = self._met(last, {b for b in range(begin + 1, min(n, begin + self.longest) + 1) if b in last})
                if met > done:
                    yield from self._path(last, done, met)
                    done = met
                    last, value = {b: x for b, x in last.items() if b >= done}, {b: x for b, x in value.items() if b >= done}
        yield from self._path(last, done, n)

    def _by_merges(self, text: str, window: int) -> Iterator[tuple[int, int, int]]:
        n, step, done = len(text), self.next, 0
        last = {0: (0, -1)}
        for begin in range(n):
            if begin not in last:
                continue
            node, left = 0, last[begin][1]
            for end in range(begin, n):
                node = step.get(node << 21 | ord(text[end]))
                if node is None:
                    break
                i = self.piece[node]
                if i >= 0 and end + 1 not in last and self.stays(left, i):
                    last[end + 1] = end + 1 - begin, i
            if begin + 1 not in last and ord(text[begin]) not in step:
                last[begin + 1] = 1, -1
            if begin + 1 - done >= window and begin + 1 < n:
                met = self._met(last, {b for b in range(begin + 1, min(n, begin + self.longest) + 1) if b in last})
                if met > done:
                    yield from self._path(last, done, met)
                    done = met
                    last = {b: x for b, x in last.items() if b >= done}
        yield from self._path(last, done, n)

    def _lanes(self, runs: list[str]) -> list[bytes]:
        """The ids of many runs, by the same steps for all of them at once: from each boundary in turn, all lanes follow the tree of
        pieces a character at a time."""
        length = np.array([*map(len, runs)])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        n, width, step, ring = len(runs), int(length[0]), self.longest, _RING * self.longest
        text = np.zeros((n, width), np.int64)
        flat = np.frombuffer("".join(runs[i] for i in order).encode("utf-32-le"), np.uint32)
        text[np.arange(width) < length[:, None]] = flat
        # of each boundary in the ring: the piece that ends there (-1: one outside the vocabulary, -2: none) and where it began
        last, begins = np.full((n, ring), -2, np.int32), np.zeros((n, ring), np.int32)
        last[:, 0] = -1
        done, lost = np.zeros(n, np.int64), np.zeros(n, bool)
        count, ids, starts = np.zeros(n, np.int64), np.full((n, width), -2, np.int32), np.zeros((n, width), np.int32)

        def commit(rows: np.ndarray, end: np.ndarray) -> None:
            """Gives out the pieces from what is done to the boundaries `end`."""
            at, k, back = end.copy(), np.zeros(len(rows), np.int64), []
            left = np.flatnonzero(at > done[rows])
            while len(left):
                lane, slot = rows[left], at[left] % ring
                at[left] = begins[lane, slot]
                back.append((left, last[lane, slot], at[left]))
                k[left] += 1
                left = left[at[left] > done[lane]]
            for j, (some, piece, start) in enumerate(back):
                place = count[rows[some]] + k[some] - 1 - j
                ids[rows[some], place], starts[rows[some], place] = piece, start
            count[rows] += k
            done[rows] = end

        def met(rows: np.ndarray, begin: int) -> np.ndarray:
            """The boundary at which the paths of all boundaries that may still grow, those from `begin` on, have met."""
            base = begin - ring + step
            alive = np.zeros((len(rows), ring), bool)
            alive[:, ring - step :] = last[rows[:, None], (begin + np.arange(step)) % ring] > -2
            paths = alive.sum(1)
            for far in range(ring - 1, -1, -1):
                go = np.flatnonzero(alive[:, far] & (paths > 1))
                if len(go):
                    to = np.maximum(begins[rows[go], (base + far) % ring] - base, 0)
                    alive[go, far] = False
                    paths[go] -= alive[go, to]
                    alive[go, to] = True
            return np.maximum(base + alive.argmax(1), done[rows])

        tree, pairs = self._tree, self._pairs
        for begin in range(width):
            rows = np.arange(np.searchsorted(-length, -begin, side="left"))  # those longer than begin
            if begin and begin % step == 0:
                commit(rows, met(rows, begin))
            # the ring's slot for the farthest boundary from here is that of one long past
            slot = (begin + step) % ring
            if begin + step >= ring:
                lost[rows] |= done[rows] < begin + step - ring
                last[rows, slot] = -2
            rows = rows[last[rows, begin % ring] > -2]
            left = last[rows, begin % ring].astype(np.int64)
            node = np.zeros(len(rows), np.int64)
            for end in range(begin, min(width, begin + step)):
                longer = length[rows] > end
                rows, left, node = rows[longer], left[longer], node[longer]
                node = tree.get(node << 21 | text[rows, end])
                alive, slot = node >= 0, (end + 1) % ring
                if end == begin:
                    strange = rows[~alive]
                    strange = strange[last[strange, slot] == -2]
                    last[strange, slot], begins[strange, slot] = -1, begin
                rows, left, node = rows[alive], left[alive], node[alive]
                if not len(rows):
                    break
                i = self._piece_at[node]
                ask = np.flatnonzero((i >= 0) & (last[rows, slot] == -2))
                if len(ask):
                    key = (left[ask] + 1) << 32 | i[ask]
                    found = pairs.get(key)
                    new = np.unique(key[found < 0])
                    if len(new):
                        # put() may clear the map, so the answers found before are kept
                        values = np.array([self._unmerged((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
                        pairs.put(new, values)
                        found[found < 0] = values[np.searchsorted(new, key[found < 0])]
                    ask = ask[found == 1]
                    last[rows[ask], slot], begins[rows[ask], slot] = i[ask], begin
        whole = np.flatnonzero(~lost)
        commit(whole, length[whole])
        strange = (ids == -1).any(1)
        given = ids[np.arange(width) < count[:, None]].tobytes()
        ends = np.cumsum(count) * 4
        out = [b""] * n
        for k, (i, a, b) in enumerate(zip(order.tolist(), (ends - 4 * count).tolist(), ends.tolist(), strict=True)):
            if lost[k]:
                out[i] = self._run(runs[i])
            else:
                out[i] = self._with_bytes(runs[i], ids[k, : count[k]].tolist(), starts[k, : count[k]].tolist()) if strange[k] else given[a:b]
        return out

    def _with_bytes(self, run: str, ids: list[int], starts: list[int]) -> bytes:
        out: list[int] = []
        for i, start in zip(ids, starts, strict=True):
            out += [i] if i >= 0 else [self.bytes[b] for b in run[start].encode()] if self.bytes else [self.unknown]
        return array("i", out).tobytes()

    def _met(self, last: dict[int, tuple[int, int]], paths: set[int]) -> int:
        """The boundary at which all these paths have met: the farthest along goes back until one is left."""
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(far - last[far][0])
        return min(paths)

    @staticmethod
    def _path(last: dict[int, tuple[int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
        out = []
        while end > start:
            length, i = last[end]
            out.append((end - length, end, i))
            end -= length
        return out[::-1]

    # ------------------------------------------------ texts

    def _run(self, run: str) -> bytes:
        found = [*self.search(run)]
        return self._with_bytes(run, [i for _, _, i in found], [a for a, _, _ in found])

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers. What the texts' runs have in common is searched once."""
        split = [self.runs.findall((SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        before = self._before
        ids = {run: before.get(run) for runs in split for run in runs}
        lanes = sorted((run for run, x in ids.items() if x is None and len(run) <= _LANE), key=len) if self.kind == BPE else []
        for a in range(0, len(lanes), _AT_ONCE):
            part = lanes[a : a + _AT_ONCE]
            ids.update(zip(part, self._lanes(part), strict=True))
        for run in [run for run, x in ids.items() if x is None]:
            ids[run] = self._run(run)
        self._before = {run: x for run, x in ids.items() if len(run) <= _LANE}
        return [b"".join(map(ids.__getitem__, runs)) for runs in split]

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encoded([text])[0]).tolist()

    def decode(self, ids: list[int] | None) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD, control pieces and ids that are null or out of range nothing."""
        try:
            if len(ids or ()) and min(ids) < 0:
                raise IndexError
            out = b"".join(map(self.raw.__getitem__, ids or []))
        except (IndexError, TypeError):
            out = b"".join(self.raw[i] for i in ids if i is not None and 0 <= i < len(self.raw))
        text = out.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[int, Model] = {}


def _loaded(data: bytes) -> Model:
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = Model(data)
    return _LOADED[key]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read by the driver; executors get them by a broadcast of that fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, decoded: bool = False, compared: bool = False) -> DataFrame:
    """doc_id and ids of every row's whole text, with `decoded` also what the ids give back, and with `compared` whether that is the text.

    Null and empty texts have no ids and give back an empty text; a null text has no comparison. A very long text is encoded whole, one
    at a time: the search holds its window, besides the text and its ids. Repeated rows give repeated rows, a null doc_id is carried
    along, an empty table gives an empty frame, and other columns are left out, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(held.value)
        for batch in batches:
            for part in chunks(byte_lengths(batch.column(1)), _CHARS):
                n = part.stop - part.start
                ids = m.encoded(batch.column(1).slice(part.start, n).to_pylist())
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns = [batch.column(0).slice(part.start, n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
                if decoded:
                    columns.append(pa.array([m.decode(array("i", x)) for x in ids], pa.string()))
                if compared:
                    texts = batch.column(1).slice(part.start, n)
                    back = columns[2].to_pylist() if decoded else (m.decode(array("i", x)) for x in ids)
                    columns.append(pa.array([None if t is None else b == t for t, b in zip(texts.to_pylist(), back, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", *["decoded"] * decoded, *["same_text"] * compared]
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded + ", same_text boolean" * compared
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Adds the decoded text to a frame with ids; a column `decoded` that is there already is replaced.

    Texts come back as they were, but for U+2581, which comes back as a space. Null or empty ids give an empty text. Repeated rows and
    other columns stay, an empty table gives an empty frame.
    """
    held = encoded.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        m = _loaded(held.value)
        return pa.array([m.decode(x.as_py()) for x in ids], pa.string())

    return encoded.withColumn("decoded", text("ids"))
