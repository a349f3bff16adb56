"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are vector operations over the flat bytes of many texts. Trees are grown level by level on binned statistics and
then laid out as arrays (statistic, threshold and value of each node of complete binary trees), which numpy walks for all
documents at once: one step for each level and tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, byte_lengths, chunks, frugal, group_starts, spread, windows
from .langid import remainder

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?", "odd": b"#$%&*|<>{}[]\\/_=+@~^", "quote": b"\"'()-", "newline": b"\n", "blank": b" \t", "high": range(128, 256)}
NAMES = ("log_bytes", "log_words", *_CLASSES, "words_odd_end", "words_upper", "word_mean", "word_std", "word_most", "distinct_words", "distinct_pairs", "repeat_next", "lines", "line_words", "short_words", "capital_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; an empty or null text has zeros."""
    t = Text(texts)
    n_docs = len(t.offsets) - 1
    size = np.diff(t.offsets) - 1
    n = t.n_words
    out = np.zeros((n_docs, len(NAMES)))
    column = {name: k for k, name in enumerate(NAMES)}
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    out[:, column["log_bytes"]], out[:, column["log_words"]] = np.log1p(size), np.log1p(n)
    kind = np.zeros(256, np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        kind[list(members)] = k + 1
    kinds = kind[t.data]
    for k, name in enumerate(_CLASSES):
        marks = np.concatenate([[0], np.cumsum(kinds == k + 1, dtype=np.int64)])
        marked = np.diff(marks[t.offsets]) - (name == "blank")  # less the space behind each text
        out[:, column[name]] = marked / per_byte
        if name == "newline":
            lines = np.diff(marks[t.offsets]) + 1
    out[:, column["lines"]], out[:, column["line_words"]] = np.log1p(lines), n / lines

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[t.first])

    if len(t.starts):
        length = t.ends - t.starts
        last, head = kinds[t.ends - 1], kinds[t.starts]
        odd, upper, low = (1 + list(_CLASSES).index(x) for x in ("odd", "upper", "lower"))
        lower_before = np.concatenate([[0], np.cumsum(kinds == low, dtype=np.int64)])
        all_upper = (head == upper) & (lower_before[t.ends] == lower_before[t.starts]) & (length > 1)
        mean = by_doc(length) / per_word
        out[:, column["word_mean"]] = mean
        out[:, column["word_std"]] = np.sqrt(np.maximum(0, by_doc(length.astype(np.float64) ** 2) / per_word - mean**2))
        full = np.flatnonzero(n)
        out[full, column["word_most"]] = np.log1p(np.maximum.reduceat(length, t.first[:-1][full]))
        out[:, column["words_odd_end"]] = by_doc(last == odd) / per_word
        out[:, column["words_upper"]] = by_doc(all_upper) / per_word
        out[:, column["capital_words"]] = by_doc(head == upper) / per_word
        out[:, column["short_words"]] = by_doc(length <= 3) / per_word
        doc, hashes = t.doc_of_word(), t.word_hashes()
        out[:, column["distinct_words"]] = _distinct(doc, hashes, n_docs) / per_word
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])])
        out[:, column["repeat_next"]] = by_doc(same) / per_word
        pairs = windows(hashes, 2)
        inside = doc[:-1] == doc[1:]
        out[:, column["distinct_pairs"]] = _distinct(doc[:-1][inside], pairs[inside], n_docs) / np.maximum(n - 1, 1)
    return out


def _distinct(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    keys = np.sort((hashes & np.uint64((1 << 44) - 1)) | (doc.astype(np.uint64) << np.uint64(44)))
    return np.bincount((keys[group_starts(keys)] >> np.uint64(44)).astype(np.int64), minlength=n_docs)


class Trees:
    """Boosted trees for a 0/1 label with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 20, ridge: float = 1.0):
        self.depth = depth
        nodes = (1 << (depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int32)
        self.threshold = np.full((trees, nodes), np.inf)
        self.value = np.zeros((trees, nodes))
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        margin = np.full(len(y), self.base)
        for k in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                slot = at - first
                best, split = np.full(width, 1e-6), {}
                for f in range(x.shape[1]):
                    cell = slot * bins + binned[:, f]
                    g, h, c = (np.cumsum(np.bincount(cell, w, width * bins).reshape(width, bins), 1) for w in (grad, hess, None))
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    gain[(c < least) | (c[:, -1:] - c < least)] = 0
                    cut = gain.argmax(1)
                    for s in np.flatnonzero(gain[np.arange(width), cut] > best):
                        best[s], split[s] = gain[s, cut[s]], (f, cut[s])
                for s, (f, cut) in split.items():
                    self.feature[k, first + s], self.threshold[k, first + s] = f, cuts[f][cut]
                at = 2 * at + 1 + (x[np.arange(len(y)), self.feature[k, at]] > self.threshold[k, at])
            g, h = np.bincount(at, grad, nodes), np.bincount(at, hess, nodes)
            self.value[k] = rate * g / (h + ridge)
            margin += self.value[k, at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            margin += value[at]
        return 1 / (1 + np.exp(-margin))


def _rows(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(byte_lengths(batch.column(1))):
                yield make(batch.slice(part.start, part.stop - part.start))

    return spread(docs).mapInArrow(frugal(run), schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000) -> Trees:
    """Trees for labels 0/1; at most `most_rows` labelled documents are used, those with the least hash of their doc_id.

    Of rows that repeat a labelled doc_id the least text is used, and of labels that do the largest. Null texts have the statistics of
    empty ones. Other labels than 0 and 1, null ones and labels of null ids are left out; without any there are no trees.
    """
    some = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # that bound is what makes the broadcast safe
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = _rows(texts, make, "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(y), len(NAMES))
    order = np.lexsort((y, *x.T))  # the order in which rows arrive doesn't matter
    return Trees(x[order], y[order])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row's whole text.

    Null and empty texts have all statistics zero and get the score of that. A very long text is handled whole, by itself. Without any
    label, or with one class only, every score is the (clipped) share of label 1. Repeated rows give repeated rows, a null doc_id is
    carried along, an empty table gives an empty frame, and other columns are left out, whatever their names.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.probability(statistics(batch.column(1))))], ["doc_id", "score"])

    return _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double")


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 5) != 0)
