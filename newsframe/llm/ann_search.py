"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to DIMENSIONS numbers by one Gaussian matrix (2-stable: a projected squared distance over the true one is
chi-square distributed with DIMENSIONS degrees of freedom). A kd-tree over a bounded sample of projected points (SAMPLE) cuts the projected space
into cells of about CELL rows (MOST_CELLS at most, of more rows then); every row goes to its cell, which has a kd-tree of its own.
A query takes points in order of projected distance, leaf by leaf, verifies their true distances in double precision,
and stops when a point that beat its k-th best so far would, with probability CONFIDENCE, have been projected nearer than what comes next.
It does so in its own cell first; then, with the k-th distance found there, in those other cells whose boxes the stopping test doesn't exclude.
The cells' nearest are merged by query. On vectors without clusters in many dimensions the test excludes little, and the work is queries by vectors.

Equal vectors are one point with its k + 1 smallest ids, so a third of all rows alike costs no more than one row. Queries and cells meet
in blocks of about BLOCK queries: the query set is stated, and a cell keeps k rows a query. Every vector is indexed.

Null, zero-length and all-zero vectors, those with null or non-finite components and those of another length than most take no part, as queries
or candidates; nor do rows with a null id. Ties go to the smaller id. Equal rows are one candidate; rows of one id with different vectors are candidates each, of
which those at one distance are one result. With fewer candidates all are returned.
Columns but the two named ones are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut, prepare

DIMENSIONS = 8
CONFIDENCE = 0.97
LEAF = 512
#: Rows of a cell and queries of a block.
CELL = 4096
BLOCK = 16_384
#: Projected points that the cells are made from, 64 bytes each on the driver.
SAMPLE = 262_144
MOST_CELLS = SAMPLE // 8


def chi_square(x: np.ndarray | float, degrees: int = DIMENSIONS) -> np.ndarray | float:
    """Distribution function for an even number of degrees."""
    half = np.asarray(x) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, degrees // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(20_240_601).standard_normal((length, dimensions))


class KdTree:
    """Over projected points: boxes split at the median of their widest side down to LEAF points."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.lows, self.highs, self.children, self.spans = [], [], [], []
        self._build(0, len(points))

    def _build(self, a: int, z: int) -> int:
        own = self.points[self.order[a:z]]
        node = len(self.spans)
        low, high = own.min(axis=0), own.max(axis=0)
        self.lows.append(low)
        self.highs.append(high)
        self.spans.append((a, z))
        self.children.append(None)
        if z - a > LEAF:
            half = (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(own[:, int(np.argmax(high - low))], half)]
            self.children[node] = self._build(a, a + half), self._build(a + half, z)
        return node

    def _gap(self, node: int, query: np.ndarray) -> float:
        d = np.maximum(0, np.maximum(self.lows[node] - query, query - self.highs[node]))
        return float(d @ d)

    def nearest(self, query: np.ndarray):
        """(squared projected distances, points) group by group in the order of distance: each group is no farther than the next."""
        heap: list[tuple[float, int]] = [(self._gap(0, query), 0)]
        held_d, held_i = np.zeros(0), np.zeros(0, np.int64)
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (self._gap(child, query), child))
            else:
                a, z = self.spans[node]
                ids = self.order[a:z]
                held_d = np.append(held_d, ((self.points[ids] - query) ** 2).sum(axis=1))
                held_i = np.append(held_i, ids)
            bound = heap[0][0] if heap else np.inf
            if self.children[node] is None or not heap:
                ready = held_d <= bound
                if ready.any():
                    by = np.argsort(held_d[ready], kind="stable")
                    yield held_d[ready][by], held_i[ready][by]
                    held_d, held_i = held_d[~ready], held_i[~ready]


class Cells:
    """The projected space cut by a kd-tree over some of its points; the outer boxes have no end."""

    def __init__(self, points: np.ndarray, cells: int):
        self.dimension, self.at, self.children = [], [], []
        self.lows, self.highs = [], []
        self._cut(points, cells, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))
        self.dimension, self.at, self.children = np.array(self.dimension), np.array(self.at), np.array(self.children).reshape(-1, 2)
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)

    def _cut(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        """The node's number; of a cell, -1 - its number."""
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(len(low))
        if cells < 2 or not spread.max() > 0:
            self.lows.append(low)
            self.highs.append(high)
            return -len(self.lows)
        d = int(np.argmax(spread))
        ordered = np.sort(points[:, d])
        at = ordered[len(ordered) * (cells // 2) // cells]
        at = at if at > ordered[0] else ordered[np.searchsorted(ordered, at, "right")]
        node = len(self.at)
        self.dimension.append(d)
        self.at.append(at)
        self.children.append([0, 0])
        below, above = high.copy(), low.copy()
        below[d] = above[d] = at
        left = points[:, d] < at
        self.children[node] = [self._cut(points[left], cells // 2, low, below), self._cut(points[~left], cells - cells // 2, above, high)]
        return node

    def find(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64) if len(self.at) else np.full(len(points), -1)
        while len(open_ := np.flatnonzero(node >= 0)):
            own = node[open_]
            node[open_] = self.children[own, (points[open_, self.dimension[own]] >= self.at[own]).astype(int)]
        return -1 - node

    def within(self, query: np.ndarray, squared: float) -> np.ndarray:
        """The cells whose boxes come that near."""
        gap = np.maximum(0, np.maximum(self.lows - query, query - self.highs))
        return np.flatnonzero((gap**2).sum(axis=1) <= squared)


class StableIndex:
    """A cell's distinct vectors, each with some ids."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.matrix = projection(vectors.shape[1])
        self.tree = KdTree(vectors @ self.matrix)

    def search(self, query_id: int, query: np.ndarray, limit: float, bound: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest of those not farther than bound."""
        best: list[tuple[float, int]] = []
        for near, points in self.tree.nearest(query @ self.matrix):
            if near[0] > limit * bound**2:
                break
            distances = np.sqrt(((self.vectors[points] - query) ** 2).sum(axis=1))
            points, distances = points[distances <= bound], distances[distances <= bound]
            found = [(d, i) for d, p in zip(distances.tolist(), points.tolist(), strict=True) for i in self.ids[p] if i != query_id]
            best = heapq.nsmallest(self.k, {*best, *found})
            if len(best) == self.k:
                bound = min(bound, best[-1][0])
        return best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_FOUND = "query_id long, score double, vec_id long"


def _search_cell(k: int, limit: float):
    def search(_, queries: pa.Table, points: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int]] = []
        if queries.num_rows and points.num_rows:
            index = StableIndex(points.column("ids").to_pylist(), _matrix(points.column("v")), k)
            for i, q, bound in zip(queries.column("id").to_pylist(), _matrix(queries.column("v")), queries.column("bound").to_pylist(), strict=True):
                out += [(i, d, j) for d, j in index.search(i, q, limit, bound)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "score": pa.array(b, pa.float64()), "vec_id": pa.array(c, pa.int64())})

    return search


def _with_cells(frame: DataFrame, cells: Broadcast, limit: float) -> DataFrame:
    """frame with `cell`: that of v; or, where frame has home and bound, a row for each other cell that is within the bound by the stopping test."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("v"))
            points = points @ projection(points.shape[1])
            if "bound" not in batch.schema.names:
                yield batch.append_column("cell", pa.array(cells.value.find(points), pa.int64()))
                continue
            near = [cells.value.within(p, limit * b**2) for p, b in zip(points, batch.column("bound").to_pylist(), strict=True)]
            near = [c[c != home] for c, home in zip(near, batch.column("home").to_pylist(), strict=True)]
            rows = np.repeat(np.arange(len(near)), list(map(len, near)))
            for a in range(0, len(rows), 10_000):  # a query may have very many cells
                part = batch.take(pa.array(rows[a : a + 10_000]))
                yield part.append_column("cell", pa.array(np.concatenate(near)[a : a + 10_000], pa.int64()))

    return frame.mapInArrow(batches, T.StructType([*frame.schema.fields]).add("cell", "long"))


def usable_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, as floats if they are such, else as doubles; of several lengths the most frequent one (the least of those)."""
    floats = embeddings.select(F.col(f"`{embedding}`")).schema[0].dataType == T.ArrayType(T.FloatType())
    vector = F.col(f"`{embedding}`").cast("array<float>" if floats else "array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length[0] if length else 0))


def nearest_neighbours(embeddings: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest that each query finds. is_query: from the id column to a condition."""
    spark = embeddings.sparkSession
    prepare(spark)
    limit = quantile(confidence)
    rows = cut(usable_vectors(embeddings, vec_id, embedding).distinct())
    same = Window.partitionBy("v").orderBy("id")  # a task keeps k + 1 ids of a vector before anything is shuffled
    points = cut(rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = points.select("v") if n <= SAMPLE else points.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(SAMPLE / n * 0.9 * (1 << 30))).limit(SAMPLE)
    taken = _projected(sample)
    cells = spark.sparkContext.broadcast(Cells(taken, min(MOST_CELLS, -(-n // CELL))))
    dealt = _with_cells(points, cells, limit)
    asked = cut(_with_cells(rows.filter(is_query(F.col("id"))), cells, limit).withColumnRenamed("cell", "home"))
    blocks = max(1, -(-asked.count() // BLOCK))

    def meet(queries: DataFrame) -> DataFrame:
        queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
        copies = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return queries.groupBy("cell", "block").cogroup(copies.groupBy("cell", "block")).applyInArrow(_search_cell(k, limit), _FOUND)

    own = cut(meet(asked.withColumn("cell", F.col("home")).withColumn("bound", F.lit(math.inf))).distinct())
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = own.withColumn("rank", F.row_number().over(order))
    bounds = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    further = asked.join(bounds, "id", "left").select("id", "v", "home", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    found = own.unionByName(meet(_with_cells(further, cells, limit))).distinct()
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _projected(vectors: DataFrame) -> np.ndarray:
    """Projected points of a bounded table, on the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                points = _matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array((points @ projection(points.shape[1])).tolist(), pa.list_(pa.float64()))], names=["p"])

    return _matrix(vectors.mapInArrow(batches, "p array<double>").toArrow().column("p"))
