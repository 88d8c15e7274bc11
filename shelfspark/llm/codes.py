"""Vector codes from codebooks that a filtering Lloyd iteration trains over all vectors.

Vectors are integers cut into equal parts. Every partition builds, once, a kd-tree for each part position
over blocks of its vectors; nodes keep their bounding box, the sum of their points and their number. A
round walks the trees downward with the entries that may still be nearest: an entry is dropped from a node
if another is at least as near for every point of the box, and a node that one entry is left for goes to
it as a whole, with its kept sum. Only points of the last nodes are measured one by one. Sums and counts of
each entry are added up by Spark; of a round the driver sees the entries alone, of fixed number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import Tables, narrow

#: Points of a node that is split no more, and vectors of a block.
LEAF, BLOCK = 16, 4096
#: Greatest absolute value of a component after scaling: squared distances of long vectors still fit a long.
MOST = 1 << 25


@dataclass
class Tree:
    order: np.ndarray  # the points, leaf by leaf
    bounds: list[np.ndarray]  # of each level: where its nodes begin in `order`, and the end
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]


def build(x: np.ndarray) -> Tree:
    """A balanced kd-tree, level by level; nodes are halved along their box's longest side."""
    n = len(x)
    order, bounds = np.arange(n), np.array([0, n])
    tree = Tree(order, [], [], [], [])
    while True:
        own = x[order]
        low, high = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
        for name, value in (("bounds", bounds), ("low", low), ("high", high), ("total", np.add.reduceat(own, bounds[:-1]))):
            getattr(tree, name).append(value)
        size = np.diff(bounds)
        if size.min() < 2 * LEAF:
            tree.order = order
            return tree
        node = np.repeat(np.arange(len(size)), size)
        side = (high - low).argmax(1)
        order = order[np.lexsort((own[np.arange(n), side[node]], node))]
        bounds = np.sort(np.concatenate([bounds, bounds[:-1] + size // 2]))


def walk(tree: Tree, x: np.ndarray, entries: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each entry, ties to the lower index; `near` gets each point's entry."""
    k, w = entries.shape
    total, count = np.zeros((k, w), np.int64), np.zeros(k, np.int64)
    at, may = np.array([0]), np.ones((1, k), bool)
    index = np.arange(k)
    for level, bounds in enumerate(tree.bounds):
        low, high = tree.low[level][at], tree.high[level][at]
        middle = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(2)
        best = np.where(may, middle, np.iinfo(np.int64).max).argmin(1)
        gap = entries[None] - entries[best][:, None]
        corner = np.where(gap > 0, high[:, None], low[:, None])
        lead = ((entries[None] - corner) ** 2).sum(2) - ((entries[best][:, None] - corner) ** 2).sum(2)
        may &= (lead < 0) | ((lead == 0) & (index[None] <= best[:, None]))
        one = may.sum(1) == 1
        whole, to = at[one], may[one].argmax(1)
        np.add.at(total, to, tree.total[level][whole])
        np.add.at(count, to, bounds[whole + 1] - bounds[whole])
        if near is not None:
            for node, entry in zip(whole.tolist(), to.tolist(), strict=True):
                near[tree.order[bounds[node] : bounds[node + 1]]] = entry
        at, may = at[~one], may[~one]
        if not len(at):
            return total, count
        if level + 1 < len(tree.bounds):
            at, may = (np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(may, 2, axis=0))
    size = bounds[at + 1] - bounds[at]
    begin = np.cumsum(size) - size
    points = tree.order[np.arange(size.sum()) + np.repeat(bounds[at] - begin, size)]
    may = np.repeat(may, size, axis=0)
    for s in range(0, len(points), 1024):
        own, mine = points[s : s + 1024], may[s : s + 1024]
        away = ((x[own][:, None] - entries[None]) ** 2).sum(2)
        to = np.where(mine, away, np.iinfo(np.int64).max).argmin(1)
        np.add.at(total, to, x[own])
        np.add.at(count, to, 1)
        if near is not None:
            near[own] = to
    return total, count


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """One row a block: ids, labels, integer vectors, and the trees of all part positions."""
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            n = part.num_rows
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            trees = [build(np.ascontiguousarray(p)) for p in np.split(x, parts, axis=1)]
            levels = [np.concatenate([np.concatenate([t.low[i], t.high[i], t.total[i]]).ravel() for i in range(len(t.bounds))]) for t in trees]
            bounds = np.concatenate(trees[0].bounds)
            values = [pa.array([part.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1)]
            values += [pa.array([v.tobytes()], pa.binary()) for v in (x, np.stack([t.order for t in trees]).astype(np.int32), bounds, np.stack(levels))]
            yield pa.RecordBatch.from_arrays(values, ["ids", "labels", "vectors", "orders", "bounds", "nodes"])


BLOCKS = "ids array<long>, labels array<long>, vectors binary, orders binary, bounds binary, nodes binary"


def _read(row: dict, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """The vectors and the tree of each part position of a block."""
    x = np.frombuffer(row["vectors"], np.int64).reshape(len(row["ids"]), -1)
    n, w = len(x), x.shape[1] // parts
    orders, flat = np.frombuffer(row["orders"], np.int32).reshape(parts, n), np.frombuffer(row["nodes"], np.int64).reshape(parts, -1)
    every, bounds, at = np.frombuffer(row["bounds"], np.int64), [], 0
    while at < len(every):
        bounds.append(every[at : at + (1 << len(bounds)) + 1])
        at += len(bounds[-1])
    for p in range(parts):
        tree, at = Tree(orders[p], bounds, [], [], []), 0
        for b in bounds:
            m = (len(b) - 1) * w
            for level in (tree.low, tree.high, tree.total):
                level.append(flat[p, at : at + m].reshape(-1, w))
                at += m
        yield np.ascontiguousarray(x[:, p * w : (p + 1) * w]), tree


def _summed(batches: Iterator[pa.RecordBatch], book) -> Iterator[pa.RecordBatch]:
    """Of all blocks of a task: part, entry, position (-1: the number of points) and sum."""
    parts, k, w = book.value.shape
    all_sums = np.zeros((parts, k, w + 1), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            for p, (x, tree) in enumerate(_read(batch.slice(i, 1).to_pylist()[0], parts)):
                total, count = walk(tree, x, book.value[p])
                all_sums[p, :, 1:] += total
                all_sums[p, :, 0] += count
    at = np.indices(all_sums.shape).reshape(3, -1)
    some = all_sums.ravel() != 0
    yield pa.RecordBatch.from_arrays([pa.array(at[0][some]), pa.array(at[1][some]), pa.array(at[2][some] - 1), pa.array(all_sums.ravel()[some])], ["part", "entry", "position", "total"])


def _coded(batches: Iterator[pa.RecordBatch], book) -> Iterator[pa.RecordBatch]:
    """vec_id, label, codes and squared distance of every vector of the blocks."""
    parts = len(book.value)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            n = len(row["ids"])
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, (x, tree) in enumerate(_read(row, parts)):
                near = np.zeros(n, np.int64)
                walk(tree, x, book.value[p], near)
                code[:, p] = near
                error += ((x - book.value[p][near]) ** 2).sum(1)
            text = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and the integer vector floor(scale * component) of every vector without null or non-finite components."""
    own = narrow(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    small = lambda x: F.when(F.abs(x) < MOST / scale, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"components must be under {MOST // scale}")).cast("long"))
    kept = own.where(F.col("embedding").isNotNull() & F.forall("embedding", fine))
    return kept.select("vec_id", "label", F.transform("embedding", small).alias("x"))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector.

    Codebooks begin with the parts of the `entries` vectors of smallest vec_id (of equal ids the one with the
    smaller components first; a null id counts as the greatest) and see `rounds` rounds over all vectors; an
    entry that no part chose stays. Ties go to the lower index. Rows with a null vector or a null or
    non-finite component drop out; repeated rows and null ids and labels are rows of their own. All vectors
    share one length that `parts` divides, and components stay under 2^25 / scale; else it is an error. An
    empty table gives no rows. At most 256 entries.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("an index has one byte")
    kept = integers(vectors, scale)
    sizes = kept.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if sizes["most"] is None:
        return spark.createDataFrame([], result)
    dim = sizes["most"]
    if sizes["least"] != dim or not dim or dim % parts:
        raise ValueError(f"vectors of {sizes['least']} to {dim} components do not share a length that {parts} divides")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    book = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    blocks = tables.save(kept.mapInArrow(lambda b: _blocks(b, parts), BLOCKS))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(book)  # entries * dim integers, whatever the number of vectors
        sums = blocks.mapInArrow(lambda b, sent=sent: _summed(b, sent), "part long, entry long, position long, total long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))
        found = np.zeros((parts, book.shape[1], dim // parts + 1), np.int64)
        for r in sums.collect():  # parts * entries * (width + 1) rows at most
            found[r["part"], r["entry"], r["position"] + 1] = r["total"]
        count = found[:, :, :1]
        book = np.where(count > 0, found[:, :, 1:] // np.maximum(count, 1), book)
        sent.unpersist()
    sent = spark.sparkContext.broadcast(book)
    coded = tables.save(blocks.mapInArrow(lambda b: _coded(b, sent), "vec_id long, label long, code string, error long"))
    by_label = tables.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    # few labels are sent by their size; many meet in a join whose hot labels Spark splits
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
