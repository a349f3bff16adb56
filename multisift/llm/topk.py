"""Exact top-k inner products with a KD-tree for each shard.

Rows are cut into shards of bounded size, and a tree is built once in a visit for each: it splits at medians of the widest dimension and keeps
the tight box of every node. Queries are sent to the shards and stream past the tree. A query walks it best first, by the largest inner
product a box allows, and stops once that is below its kth score. Each query visits one shard first; the kth score found there goes
with it to all others as the bound to beat.

A shard and its queries are neighbours in one sorted partition, rows first, so a task holds one shard and one batch of queries at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialise

_SCHEMA = pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND = "rid long, query_id long, vec_id long, score long"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


#: Inner products below this are whole numbers that doubles hold exactly.
_EXACT = 2.0**53


def products(x: np.ndarray, q: np.ndarray, wide: bool) -> list[int]:
    """Inner products of rows of whole doubles with a query; if wide in Python's integers, and one beyond a long is that range's end."""
    if not wide:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q.tolist()]
    return [min(max(sum(int(v) * w for v, w in zip(row, whole, strict=True)), _LEAST), _MOST) for row in x.tolist()]


class Tree:
    """Vectors of whole doubles (rows sorted into leaves) under nodes with tight boxes."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int = 128):
        self.x = x
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        order = np.arange(len(ids))
        todo = [(0, len(ids), self._node(order, 0, len(ids)))]
        while todo:
            a, b, node = todo.pop()
            spread = self.high[node] - self.low[node]
            if b - a <= leaf or not spread.any():
                continue
            middle = (b - a) // 2
            part = np.argpartition(self.x[order[a:b], int(spread.argmax())], middle)
            order[a:b] = order[a:b][part]
            left, right = self._node(order, a, a + middle), self._node(order, a + middle, b)
            self.children[node] = (left, right)
            todo += [(a, a + middle, left), (a + middle, b, right)]
        self.rids, self.ids, self.x = rids[order], ids[order], x[order]
        self.corners = np.concatenate([self.high, self.low], 1)
        self.largest = x.shape[1] * float(np.abs(x).max(initial=0))

    def _node(self, order: np.ndarray, a: int, b: int) -> int:
        x = self.x[order[a:b]]
        self.low.append(x.min(0))
        self.high.append(x.max(0))
        self.rows.append((a, b))
        self.children.append(None)
        return len(self.rows) - 1

    def best(self, rid: int, q: np.ndarray, k: int, bound: int) -> list[tuple[int, int]]:
        """Up to k (score, -vec_id) with scores of at least `bound`, of rows other than the query's own; ties go to smaller ids."""
        wide = self.largest * float(np.abs(q).max(initial=0)) >= _EXACT
        most = products(self.corners, np.concatenate([np.maximum(q, 0), np.minimum(q, 0)]), wide)  # what each box allows
        top = [(-most[0], 0)]
        found: list[tuple[int, int]] = []  # a heap, its worst first
        while top:
            allowed, node = heapq.heappop(top)
            if -allowed < bound:
                break
            children = self.children[node]
            if children:
                for c in children:
                    if most[c] >= bound:
                        heapq.heappush(top, (-most[c], c))
                continue
            a, b = self.rows[node]
            for i, score in enumerate(products(self.x[a:b], q, wide), a):
                if score < bound or self.rids[i] == rid:
                    continue
                item = (score, -int(self.ids[i]))
                if len(found) < k:
                    heapq.heappush(found, item)
                else:
                    heapq.heappushpop(found, item)
                if len(found) == k:
                    bound = max(bound, found[0][0])
        return found


def top_k(vectors: DataFrame, queries_where: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, shard_values: int = 1 << 20) -> DataFrame:
    """The k rows with the highest inner products for each query row, after components x become floor(scale * x).

    Takes vec_id and embedding; queries_where says which rows are queries. Returns query_id, rank, vec_id and score; ties go to the
    smaller vec_id.

    Rows with a null vec_id, and vectors that are null or empty, or hold a null or a component that isn't finite, take no part. Only
    vectors of the query's length are compared. Rows that repeat a vec_id are rows of their own: each is a candidate of the others, and
    as queries each gets its own ranks. Scores are exact; one beyond the range of a long counts as that range's end. With fewer than
    k candidates all are returned; an empty table gives an empty frame. Other columns are left out, whatever their names.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    largest = float(np.finfo(np.float64).max)

    def floor(x):  # as a double, also where that is no long
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(largest)), F.lit(-largest))
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)

    whole = F.transform("embedding", floor)
    rows = materialise(rows.select("vec_id", whole.alias("x"), F.monotonically_increasing_id().alias("rid"), F.expr(queries_where).alias("asks")).withColumn("dim", F.size("x").cast("long")))
    shards = {d: max(1, math.ceil(n * d / shard_values)) for d, n in rows.groupBy("dim").count().collect()}  # a row for each vector length
    n_shards = (F.create_map(*[F.lit(x) for p in shards.items() for x in p])[F.col("dim")] if shards else F.lit(1)).cast("long")
    held = rows.select("dim", F.pmod(F.xxhash64("rid"), n_shards).alias("shard"), F.lit(0).alias("turn"), "rid", "vec_id", "x", F.lit(None).cast("long").alias("bound"))
    asked = rows.where("asks").withColumn("home", F.pmod(F.xxhash64("rid", F.lit(1)), n_shards)).withColumn("n", n_shards).select("dim", "home", "n", "rid", "vec_id", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, parts = None, None, []
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "turn")), strict=True))
            edges = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(cells)], strict=True):
                part = batch.slice(a, b - a)
                rids, ids = part.column("rid").to_numpy(), part.column("vec_id").to_numpy()
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b - a, cells[a][0])
                if cells[a][:2] != cell:
                    cell, tree, parts = cells[a][:2], None, []
                if cells[a][2] == 0:
                    parts.append((rids, ids, x))
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate([p[i] for p in parts]) for i in range(2)), np.concatenate([p[2] for p in parts]))
                    parts = []
                out: list[tuple[int, int, int, int]] = []
                for rid, query_id, q, bound in zip(rids.tolist(), ids.tolist(), x, part.column("bound").to_pylist(), strict=True):
                    out += [(rid, query_id, -v, s) for s, v in tree.best(rid, q, k, _LEAST if bound is None else bound)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=_SCHEMA)

    def visit(queries: DataFrame) -> DataFrame:
        asks = queries.select("dim", "shard", F.lit(1).alias("turn"), "rid", "vec_id", "x", "bound")
        return held.unionByName(asks).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn").mapInArrow(frugal(search), _FOUND)

    first = materialise(visit(asked.withColumn("shard", F.col("home")).withColumn("bound", F.lit(None).cast("long"))))
    found = first
    if max(shards.values(), default=1) > 1:
        kth = first.groupBy("rid").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        others = asked.join(kth, "rid", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("shard <> home")
        found = first.union(visit(others))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
