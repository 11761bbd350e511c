"""Pairs of vectors by cosine, exactly, and without comparing what the triangle inequality keeps apart.

Angles between vectors are a metric. Pivots (a sample of the vectors, MOST_PIVOTS at most) cut the sphere into cells; a vector belongs to the cell of its nearest pivot. If the angle of x and y is at
most limit and x is in the cell of pivot a, then y is no further from a than from its own pivot and 2 * limit, nor than the cell's radius and limit. Only vectors for which both hold are
copied to that cell, as its border; of the two cells of a pair the one with the smaller number finds it. Where vectors have no clusters for the limit, all would be border everywhere; so cells are
counted first, and taken only where they save more than they copy. Otherwise all vectors are one cell.

Cells meet their borders in blocks of rows, so neither a large cell nor a large border is one task. A block has so many rows that there are SPREAD of them: a row is copied about that often,
whatever the size of the table, until a block has MOST_BYTES; from there on copies grow with the table. A task goes through its two blocks in tiles of TILE rows, and what it holds beside them is a tile. Without
clusters the products are the square of the vectors' number, as they would be without cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.checkpoints import stored
from ..sources.workers import importable

#: Rows that are settled in one task by those that go through groups in order.
BLOCK = 2048
#: Rows of a block of vectors at least, blocks of a table until they have MOST_BYTES of vectors, and rows of a tile of products.
LEAST_BLOCK = 512
SPREAD = 12
MOST_BYTES = 32 << 20
TILE = 1024
#: Pivots at most; they are on the driver and in each worker.
MOST_PIVOTS = 1024
#: More than rounding takes from an angle.
_SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


class _Cells:
    """Rows (id, v of length 1), the cells of pivots, and which rows are border where."""

    def __init__(self, rows: DataFrame, threshold: float, block: int):
        spark = rows.sparkSession
        importable(spark)
        self.rows = rows
        # of length 0 are no direction; with a threshold of 0 or less no angle tells anything, and all are one cell
        n, dimensions = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.n, self.block = n, max(block, min(-(-n // SPREAD), MOST_BYTES // (8 * (dimensions or 1))))
        wanted = min(MOST_PIVOTS, n // block) if threshold > 0 else 0
        sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()] if wanted > 1 else []
        self.pivots = np.unique(np.array(sample, np.float64), axis=0) if sample else np.zeros((0, 1))
        self.limit = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
        self.radii, self.sizes = np.zeros(len(self.pivots)), {(0, True): n} if n else {}
        if len(self.pivots):
            for cell, radius in self._mapped(self._radii, "cell int, radius double").groupBy("cell").agg(F.max("radius")).collect():
                self.radii[cell] = radius
            self.sizes = {(cell, core): size for cell, core, size in self._mapped(self._counts, "cell int, core boolean, n long").groupBy("cell", "core").agg(F.sum("n")).collect()}
            saved = n * (n - 1) / 2 / max(1, self.compared())
            if self.copies() > min(2, saved) * n * -(-n // self.block):
                self.pivots, self.radii, self.sizes = np.zeros((0, 1)), np.zeros(0), {(0, True): n}

    def _of_cells(self) -> list[tuple[int, int, int, int]]:
        """Own rows, rows of the border, and the blocks of both, of each cell."""
        return [(self.sizes.get((c, True), 0), self.sizes.get((c, False), 0), *self.blocks(c)) for c in range(max(1, len(self.pivots)))]

    def copies(self) -> int:
        """Rows that are moved."""
        return sum(own * (i + j) + border * i for own, border, i, j in self._of_cells())

    def compared(self) -> int:
        """Products of pairs of vectors."""
        return sum(own * (own - 1) // 2 + own * border for own, border, _, _ in self._of_cells())

    def _mapped(self, batches, schema: str) -> DataFrame:
        each = batches()

        def sliced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return each(batch.slice(a, TILE) for batch in it for a in range(0, batch.num_rows, TILE))

        return self.rows.mapInArrow(sliced, schema)

    def _radii(self):
        pivots = self.pivots

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if len(pivots) and batch.num_rows:
                    near = _angles(_matrix(batch.column(1)), pivots)
                    own = near.argmin(axis=1)
                    most = np.zeros(len(pivots))
                    np.maximum.at(most, own, near[np.arange(len(own)), own])
                    cells = np.unique(own)
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(most[cells])], names=["cell", "radius"])

        return batches

    def _dealt(self):
        """(row, cell, core) of a batch's vectors: the own cell of each, and the cells of smaller number in whose border it is."""
        pivots, limit, radii = self.pivots, self.limit, self.radii

        def deal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(pivots):
                return np.arange(len(v)), np.zeros(len(v), np.int64), np.ones(len(v), bool)
            near = _angles(v, pivots)
            own = near.argmin(axis=1)
            least = near[np.arange(len(own)), own]
            met = (near <= least[:, None] + 2 * limit + _SLACK) & (near <= radii + limit + _SLACK) & (np.arange(len(pivots)) < own[:, None])
            i, cell = np.nonzero(met)
            return np.r_[np.arange(len(own)), i], np.r_[own, cell], np.r_[np.ones(len(own), bool), np.zeros(len(i), bool)]

        return deal

    def _counts(self):
        deal = self._dealt()

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                _, cell, core = deal(_matrix(batch.column(1)))
                both, n = np.unique(cell * 2 + core, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // 2, pa.int32()), pa.array(both % 2 == 1), pa.array(n, pa.int64())], names=["cell", "core", "n"])

        return batches

    def blocks(self, cell: int) -> tuple[int, int]:
        """Blocks of the cell's own rows and of its border."""
        own, border = self.sizes.get((cell, True), 0), self.sizes.get((cell, False), 0)
        return -(-own // self.block), -(-border // self.block)

    def groups(self) -> DataFrame:
        """cell, i, j (blocks that meet; own ones first, then those of the border), side (0: left, 1: both, 2: right), and the columns of the rows: id, v and what else they have."""
        deal, blocks = self._dealt(), np.array([self.blocks(c) for c in range(max(1, len(self.pivots)))]).reshape(-1, 2)
        names = self.rows.columns

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if not batch.num_rows:
                    continue
                row, cell, core = deal(_matrix(batch.column(1)))
                ids = batch.column(0).to_numpy()
                own, border = blocks[cell, 0], blocks[cell, 1]
                spread = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                part = (spread % np.maximum(np.where(core, own, border), 1).astype(np.uint64)).astype(np.int64)
                for k in range(int((own + border).max())):
                    # an own row of block p is left of every block from p on and right of those before, a border row right of every own block
                    left, right = core & (k >= part) & (k < own + border), np.where(core, k < part, k < own)
                    for keep, i, j, side in ((left, part, np.full(len(row), k), np.where(k == part, 1, 0)), (right, np.full(len(row), k), np.where(core, part, own + part), np.full(len(row), 2))):
                        at = np.flatnonzero(keep)
                        for a in range(0, len(at), 4096):
                            own_at = at[a : a + 4096]
                            columns = [pa.array(x[own_at].astype(np.int32)) for x in (cell, i, j, side)]
                            yield pa.RecordBatch.from_arrays([*columns, *(c.take(row[own_at]) for c in batch.columns)], names=["cell", "i", "j", "side", *names])

        more = "".join(f", {name} long" for name in names[2:])
        return self._mapped(lambda: batches, f"cell int, i int, j int, side int, id long, v array<double>{more}")

    def met(self, find: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What find gives for each two blocks that meet."""
        return self.groups().groupBy("cell", "i", "j").applyInArrow(find, schema)


class _Met:
    """Two blocks that meet: ids left and right, further columns of both, and the pairs of row numbers with their cosines, tile by tile."""

    def __init__(self, batches: Iterator[pa.RecordBatch], *more: str):
        sides, ids, v, others = [], [], [], [[] for _ in more]
        for batch in batches:
            if batch.num_rows:
                sides.append(batch.column("side").to_numpy())
                ids.append(batch.column("id").to_numpy())
                v.append(_matrix(batch.column("v")))
                for kept, name in zip(others, more, strict=True):
                    kept.append(batch.column(name).to_numpy())
        side, every, vectors = (np.concatenate(x) for x in (sides, ids, v))
        a, b = side <= 1, side >= 1
        self.same = bool((side == 1).any())
        self.left, self.right, self.v, self.w = every[a], every[b], vectors[a], vectors[b]
        self.more = [(x[a], x[b]) for x in map(np.concatenate, others)]

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of a block with itself each pair of rows comes once, the one with the smaller id on the left."""
        for a in range(0, len(self.left), TILE):
            for b in range(0, len(self.right), TILE):
                score = self.v[a : a + TILE] @ self.w[b : b + TILE].T
                at = np.flatnonzero(score >= threshold)
                i, j = a + at // score.shape[1], b + at % score.shape[1]
                x, y = self.left[i], self.right[j]
                keep = x < y if self.same else x != y
                yield i[keep], j[keep], score.ravel()[at[keep]]


def _pairs_of(threshold: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches)
        for i, j, score in met.pairs(threshold):
            if len(i):
                x, y = met.left[i], met.right[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], names=["a", "b", "score"])

    return pairs


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that can be reached, of numbers 0 to n - 1 with edges x, y: labels are lowered along the edges and then along themselves."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_of(threshold: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches)
        ids, number = np.unique(np.r_[met.left, met.right], return_inverse=True)
        left, right = number[: len(met.left)], number[len(met.left) :]
        label = np.arange(len(ids))
        for i, j, _ in met.pairs(threshold):
            x, y = label[left[i]], label[right[j]]
            new = x != y
            if new.any():
                label = _components(len(ids), x[new], y[new])[label]
        some = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[some]]), pa.array(ids[some])], names=["a", "b"])

    return links


def _labels_of(threshold: float):
    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches, "label")
        left, right = met.more[0]
        names, number = np.unique(np.r_[left, right], return_inverse=True)
        x, y = number[: len(left)], number[len(left) :]
        found = np.zeros(0, np.int64)
        for i, j, _ in met.pairs(threshold):
            a, b = x[i], y[j]
            keep = a != b
            told = np.unique(np.minimum(a, b)[keep] * len(names) + np.maximum(a, b)[keep])
            found = np.union1d(found, told) if len(told) else found
        yield pa.RecordBatch.from_arrays([pa.array(names[found // len(names)]), pa.array(names[found % len(names)])], names=["x", "y"])

    return labels


def _nearest_of(threshold: float):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches)
        ids, number = np.unique(np.r_[met.left, met.right], return_inverse=True)
        x, y = number[: len(met.left)], number[len(met.left) :]
        best, kept = np.full(len(ids), -np.inf), []
        for i, j, score in met.pairs(threshold):
            later, earlier = np.maximum(x[i], y[j]), np.minimum(x[i], y[j])
            np.maximum.at(best, later, score)
            top = score == best[later]
            kept.append((later[top], earlier[top], score[top]))
        later, earlier, score = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        top = score == best[later]
        yield pa.RecordBatch.from_arrays([pa.array(ids[later[top]]), pa.array(ids[earlier[top]]), pa.array(score[top])], names=["id", "earlier", "score"])

    return nearest


def _rows(vectors: DataFrame, threshold: float, vec_id: str, v: str, *label: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), *(F.col(c).cast("long").alias("label") for c in label)).filter("id IS NOT NULL AND size(v) > 0")
    if threshold > 0:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return stored(rows.withColumn("v", unit(F.col("v"))))


def similar_pairs(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", v: str = "v", block: int = LEAST_BLOCK) -> DataFrame:
    """(a, b, score) with a < b and cosine >= threshold, all of them. Vectors are of one length, ids each once. A vector of zeros has cosine 0 with all; null and empty vectors take no part.
    block: rows of a cell, and of a block at least."""
    return _Cells(_rows(vectors, threshold, vec_id, v), threshold, block).met(_pairs_of(threshold), "a long, b long, score double")


def similar_links(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", v: str = "v", block: int = LEAST_BLOCK) -> DataFrame:
    """(a, b) that connect what the pairs of similar_pairs() connect, with a row for each row of a block at most however many pairs it has. Equal vectors are one for the pairs, and linked to the first of them."""
    rows = _rows(vectors, threshold, vec_id, v)
    firsts = stored(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = _Cells(firsts.select("id", "v"), threshold, block).met(_links_of(threshold), "a long, b long")
    if threshold > 1:
        return found
    copied = firsts.filter("n > 1").select(F.col("id").alias("a"), "v")
    return found.unionByName(rows.withColumnRenamed("id", "b").join(copied, "v").filter("a < b").select("a", "b"))


def similar_labels(vectors: DataFrame, threshold: float, label: str, vec_id: str = "vec_id", v: str = "v", block: int = LEAST_BLOCK) -> DataFrame:
    """(x, y) with x < y: the pairs of labels (long) that have a pair of vectors with cosine >= threshold, each once. Pairs of vectors stay in their task, so what is shuffled is pairs of labels."""
    rows = _rows(vectors, threshold, vec_id, v, label)
    return _Cells(rows, threshold, block).met(_labels_of(threshold), "x long, y long").distinct()


def nearest_earlier(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", v: str = "v", block: int = LEAST_BLOCK) -> DataFrame:
    """(id, earlier, score): of each vector those with a smaller id that have the largest cosine to it, if it is threshold or more; more than one only where cosines are equal."""
    found = stored(_Cells(_rows(vectors, threshold, vec_id, v), threshold, block).met(_nearest_of(threshold), "id long, earlier long, score double"))
    return found.join(found.groupBy("id").agg(F.max("score").alias("score")), ["id", "score"]).select("id", "earlier", "score")


def similarity_work(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", v: str = "v", block: int = LEAST_BLOCK) -> dict[str, int]:
    """Vectors, cells, products of pairs of vectors that similar_pairs() takes and that all pairs would take, and rows that are copied."""
    cells = _Cells(_rows(vectors, threshold, vec_id, v), threshold, block)
    return {"vectors": cells.n, "cells": max(1, len(cells.pivots)), "compared": cells.compared(), "all": cells.n * (cells.n - 1) // 2, "copies": cells.copies()}
