"""Language identification with word-first backoff.

A word that the training texts hold often enough is scored by its log frequency in each language. Another word is scored by its
character n-grams, at each place by the longest one known, from `longest` characters down to one. The log scores of a
text's words are averaged and turned into probabilities.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, release, spread

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores a worker remembers, and words scored at once.
_MEMO, _STEP = 120_000, 20_000


class Model:
    """Tables of log frequencies: one row of `scores` for each known word or n-gram, one column for each language."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]], longest: int = 4, least: int = 3):
        """words, grams: (language, word or n-gram, count); what occurs fewer than `least` times is left out, single characters aside."""
        self.langs = sorted({lang for lang, _, _ in [*words, *grams]})
        self.longest, n = longest, max(1, len(self.langs))
        column = {lang: k for k, lang in enumerate(self.langs)}

        def table(counts: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
            for lang, text, count in counts:
                out[text][column[lang]] += count
            return dict(sorted(out.items()))

        tables: list[np.ndarray] = []
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self._add(self.words, tables, {w: c for w, c in table(words).items() if c.sum() >= least})
        by_gram = table(grams)
        for size in range(1, longest + 1):
            self._add(self.grams, tables, {g: c for g, c in by_gram.items() if len(g) == size and (c.sum() >= least or size == 1)})
        self.scores = np.concatenate(tables) if tables else np.zeros((0, n))

    @staticmethod
    def _add(index: dict[str, int], tables: list[np.ndarray], counts: dict[str, np.ndarray]) -> None:
        if counts:
            rows = np.array(list(counts.values()))
            start = sum(map(len, tables))
            index |= {k: start + i for i, k in enumerate(counts)}
            tables.append(np.log((rows + 0.5) / (rows.sum(0) + 0.5 * (len(rows) + 1))))

    def backoff(self, word: str) -> np.ndarray:
        """The mean over the word's places of the longest known n-gram that starts there."""
        padded, found = f"^{word}$", []
        grams = self.grams
        for i in range(len(padded)):
            for size in range(min(self.longest, len(padded) - i), 0, -1):
                row = grams.get(padded[i : i + size])
                if row is not None:
                    found.append(row)
                    break
        return self.scores[found].mean(0) if found else np.zeros(max(1, len(self.langs)))

    def scorer(self):
        """A function from a text to (language, probability); it remembers the scores of unseen words, up to a bound."""
        known = self.words
        base = len(self.scores)
        index: dict[str, int] = {}
        matrix = np.concatenate([self.scores, np.zeros((_MEMO, max(1, len(self.langs))))])

        def row(word: str) -> int:
            r = known.get(word)
            if r is None:
                r = index.get(word)
                if r is None:
                    r = index[word] = base + len(index)
                    matrix[r] = self.backoff(word)
            return r

        def score(text: str | None) -> tuple[str, float]:
            found = _LETTERS.findall(text.lower()) if text else []
            if not self.langs or not found or not any(c.isalpha() for c in text):
                return UNKNOWN, 0.0
            total = np.zeros(len(self.langs))
            for i in range(0, len(found), _STEP):  # within a step the memory can't overflow
                if len(index) > _MEMO - _STEP:
                    index.clear()
                part = found[i : i + _STEP]
                total += matrix[np.fromiter(map(row, part), np.int64, len(part))].sum(0)
            mean = total / len(found)
            odds = np.exp((mean - mean.max()) * min(20, len(found)))
            best = int(odds.argmax())
            return self.langs[best], float(odds[best] / odds.sum())

        return score


def learn(docs: DataFrame, most_docs: int = 20_000, most_words: int = 100_000, most_grams: int = 100_000, longest: int = 4) -> Model:
    """Learns from the texts of rows whose lang is not null.

    Bounds, each shared evenly by the languages, so that a rare one keeps its part: about `most_docs` documents, those with the least
    hash of their doc_id (a language with fewer gives all it has); the `most_words` most frequent words, and the `most_grams` most
    frequent n-grams, counted over all words of those documents, whatever their length. What is frequent in one language is counted in
    all. The driver gets a row for each language, and counts of that many words and n-grams. Without a row to learn from
    nothing is known, and every text is `und`.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs = docs.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("h")).collect()
    if not langs:
        return Model([], [], longest)
    share = max(1, most_docs // len(langs))
    # the hash is even, so a share of its range is that share of the rows; the least of a language is always in
    last = {r.lang: max(r.h, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * share // r.n)) for r in langs}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in _LETTERS.findall(text.as_py().lower()):
                    seen[lang, w] += 1
                if len(seen) > _MEMO:
                    yield from _counted(seen)
                    seen.clear()
        yield from _counted(seen)

    limits = F.create_map(*[F.lit(x) for p in last.items() for x in p])
    counts = spread(docs.where(F.col("h") <= limits[F.col("lang")]).select("text", "lang")).mapInArrow(frugal(count), "lang string, word string, n long")
    words = materialise(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit("^"), "word", F.lit("$"))

    def pieces(size: int) -> Column:
        last = F.char_length(padded) - (size - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    grams = words.select("lang", F.explode(F.array_distinct(F.concat(*(pieces(size) for size in range(1, longest + 1))))).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def frequent(counts: DataFrame, what: str, most: int) -> list[tuple]:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), what))
        top = counts.withColumn("rank", rank).where(F.col("rank") <= max(1, most // len(langs))).select(what).distinct()
        return [tuple(r) for r in counts.join(top, what, "left_semi").select("lang", what, "n").collect()]

    return Model(frequent(words, "word", most_words), frequent(grams, "gram", most_grams), longest)


def _counted(seen: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    items = list(seen.items())
    for i in range(0, len(items), 50_000):
        part = items[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row's whole text.

    A null text, and one without letters, is `und` with score 0; so is every text if nothing could be learned. A very long text is
    scored in steps, of which only the sum is kept. Repeated rows give repeated rows, a null doc_id is carried along, an empty table
    gives an empty frame, and other columns are left out, whatever their names. Ties go to the first language by code point.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()'s limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def only_known(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows, all columns, whose text has a language with at least `least` probability.

    Null texts and texts without letters go. Repeated rows stay or go together. No column is added, so names can't clash. An empty table
    gives an empty frame.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(held.value.scorer())
        out = pa.array([p if lang != UNKNOWN else 0.0 for lang, p in (scorers[0](t.as_py()) for t in texts)], pa.float64())
        release()
        return out

    return spread(docs).where(score(F.col("text")) >= least)


def remainder(doc_id: str, divisor: int):
    """crc32 of the id's text, modulo the divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 3) != 1)


__all__ = ["Model", "UNKNOWN", "identify", "learn", "only_known", "remainder", "train_rows"]
