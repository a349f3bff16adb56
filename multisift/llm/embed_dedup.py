"""Embedding near-dedup by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard transform, and names the axis (with its sign) that is then
nearest; three such hashes make a table's key. In each table a vector is indexed under its own key and probes, besides that, the
keys that replace one of the hashes by its next best axes. What meets there is a candidate pair, verified by its cosine in double
precision.

Pairs are rows only where they are few: at keys where up to _FEW pairs meet. A larger key is a grid of cells, each of two blocks of vectors,
and a cell gives a spanning forest of its links by one matrix product. The links join vectors to components; a component is a grid
of cells too, in which the links of each vector are counted. So neither the candidates nor the links of a dense group are
ever listed, and its work is spread over as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, frugal, grouped, joined_hot, materialise

#: Pairs at a key that are listed as rows, and vectors on one side of a cell.
_FEW, _BLOCK = 4096, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The `probes` nearest axes of each row after a random turn: 2 * axis, plus one where it points the other way."""
    width = max(8, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return 2 * order + (np.take_along_axis(x, order, 1) < 0)


def table_keys(x: np.ndarray, tables: int, probes: int, hashes: int = 3) -> np.ndarray:
    """(rows, tables, keys): a vector's own key in each table first, then those it probes, which replace one of the hashes."""
    out = []
    size = 4 * max(8, 1 << (x.shape[1] - 1).bit_length())
    for t in range(tables):
        near = [axes(x, hashes * t + h, probes + 1) for h in range(hashes)]
        base = sum(a[:, 0] * size**h for h, a in enumerate(near))
        keys = [base] + [base + (a[:, p] - a[:, 0]) * size**h for h, a in enumerate(near) for p in range(1, a.shape[1])]
        out.append(np.stack(keys, 1) * tables + t)
    return np.stack(out, 1)


def _rows(x: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled so that squares neither overflow nor vanish, and brought to length one."""
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what a matrix of links connects, as (row, column): each search reaches a row or column once."""
    rows_left, columns_left = near.any(1), near.any(0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while rows_left.any():
        todo = [int(rows_left.argmax())]
        rows_left[todo[0]] = False
        while todo:
            row = todo.pop()
            columns = np.flatnonzero(near[row] & columns_left)
            columns_left[columns] = False
            found.append((np.full(len(columns), row), columns))
            for column in columns.tolist():
                rows = np.flatnonzero(near[:, column] & rows_left)
                rows_left[rows] = False
                found.append((rows, np.full(len(rows), column)))
                todo.extend(rows.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 10, probes: int = 3) -> DataFrame:
    """Links vectors of equal, non-null label whose cosine is at least `cosine`.

    Returns vec_id, n_links (other rows linked directly), component_id (the least vec_id reachable) and kept (it is the
    component's own), one row for each input row.

    Null, empty or zero vectors, vectors with components that are null or not finite, and rows without a label or a vec_id
    link with nothing: 0 links, their own component, kept. Only vectors of one length are compared. Equal vectors of one label
    are linked without being hashed, and are compared as one; each counts. Which vectors come together is a matter of recall, measured in
    tests/llm; within what has come together every link is found and exact. Rows that repeat a vec_id are rows of their own, with
    the links of their own vector and label, and kept if their vec_id is the component's; repeated rows are links of each
    other. An empty table gives an empty frame. Other columns are left out, whatever their names.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x"), F.col("label").cast("string").alias("label"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("x", lambda v: v != 0)
    part = F.coalesce(fine & some & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # a class is named by 128 bits of its label and vector; g: its label and length
    named = rows.withColumn("h", F.xxhash64("label", "x")).withColumn("i", F.xxhash64("x", "label"))
    classes = named.where(part).groupBy("h", "i").agg(F.first("x").alias("x"), F.first("label").alias("label"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialise(classes.select("h", "i", "x", F.xxhash64("label", F.size("x")).alias("g"), "least", "copies", F.monotonically_increasing_id().alias("id")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("x").offsets.to_numpy())
            for width in np.unique(size).tolist():
                part = batch.filter(pa.array(size == width))
                keys = table_keys(_rows(part.column("x")), tables, probes)
                own = np.zeros(keys.shape, np.int64)
                own[:, :, 0] = 1
                per = keys.shape[1] * keys.shape[2]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * per), pa.array((2 * keys + own).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("g"), lists], ["id", "g", "keys"])

    keys = materialise(classes.select("id", "g", "x").mapInArrow(frugal(hashed), "id long, g long, keys array<long>"))
    keys = keys.select("id", "g", F.explode("keys").alias("key")).select("id", "g", F.shiftright("key", 1).alias("key"), (F.col("key") % 2 == 1).alias("own"))
    sizes = keys.groupBy("g", "key").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n_own") * F.col("n") > _FEW))
    marked = joined_hot(keys, large, ["g", "key"], "id", "left")

    # few pairs at a key
    few = marked.where("n IS NULL").select("id", "g", "key", "own")
    pairs = few.where("own").select("g", "key", F.col("id").alias("a")).join(few.select("g", "key", F.col("id").alias("b")), ["g", "key"])
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end, x in (("a", "x"), ("b", "y")):
        pairs = pairs.join(classes.select(F.col("id").alias(end), F.col("x").alias(x)), end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("x").offsets.to_numpy())
            for width in np.unique(size).tolist():
                part = batch.filter(pa.array(size == width))
                ok = (_rows(part.column("x")) * _rows(part.column("y"))).sum(1) >= cosine
                yield part.filter(pa.array(ok)).select(["a", "b"])

    links = pairs.select("a", "b", "x", "y").mapInArrow(frugal(verify), "a long, b long")

    # many: a grid of cells; side 0 of a cell is indexed there, side 1 probes
    def grid(frame: DataFrame, mine: str, of: str, others: str) -> DataFrame:
        """Each row with the number of its block, and once for each block of the other side."""
        frame = frame.withColumn(mine, F.pmod(F.xxhash64("id", F.lit(mine)), F.ceil(F.col(of) / _BLOCK)))
        return frame.withColumn("j" if mine == "i" else "i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(others) / _BLOCK).cast("long") - 1)))

    many = marked.where("n IS NOT NULL")
    cells = grid(many.where("own"), "i", "n_own", "n").select("g", "key", "i", "j", F.lit(0).alias("side"), "id")
    cells = cells.unionByName(grid(many, "j", "n", "n_own").select("g", "key", "i", "j", F.lit(1).alias("side"), "id")).join(classes.select("id", "x"), "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in grouped(batches, ["g", "key", "i", "j"]):
            side, ids, x = cell.column("side").to_numpy(), cell.column("id").to_numpy(), _rows(cell.column("x").combine_chunks())
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            left, right = _forest(x[a] @ x[b].T >= cosine)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[left]]), pa.array(ids[b[right]])], ["a", "b"])

    dense = cells.repartition("g", "key", "i", "j").sortWithinPartitions("g", "key", "i", "j").mapInArrow(frugal(meet), "a long, b long")
    groups = connected_components(links.union(dense).where("a <> b"))

    # each component's links, counted in cells of two of its blocks
    members = groups.withColumnRenamed("node", "id").join(classes.select("id", "least"), "id")
    members = materialise(joined_hot(members, members.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id")), ["component"], "id"))
    blocks = grid(members, "i", "n", "n").join(classes.select("id", "x", "copies"), "id")
    blocks = blocks.select("component", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("second"), "id", "copies", "x")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in grouped(batches, ["component", "lo", "hi"]):
            ids, copies, x = cell.column("id").to_numpy(), cell.column("copies").to_numpy(), _rows(cell.column("x").combine_chunks())
            second = cell.column("second").to_numpy()
            a, b = (np.arange(len(ids)),) * 2 if key[1] == key[2] else (np.flatnonzero(~second), np.flatnonzero(second))
            near = x[a] @ x[b].T >= cosine
            if key[1] == key[2]:
                np.fill_diagonal(near, False)
                found = [(ids, near @ copies)]
            else:
                found = [(ids[a], near @ copies[b]), (ids[b], near.T @ copies[a])]
            for who, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n, pa.int64())], ["id", "n_links"])

    counts = blocks.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(frugal(count), "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    linked = classes.select("h", "i", "id", "least", "copies").join(members.select("id", "component_id").join(counts, "id"), "id", "left")
    linked = linked.select("h", "i", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    taking = joined_hot(named.where(part).select("vec_id", "h", "i"), linked, ["h", "i"], "vec_id").select("vec_id", "n_links", "component_id")
    return taking.union(rows.where(~part).select("vec_id", F.lit(0).cast("long"), "vec_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
