"""Hard-negative mining over Hilbert-ordered blocks of candidates with zone maps.

Components are whole numbers, floor(SCALE * x). The rows are ordered by length of vector, label and place on a Hilbert curve through the HILBERT dimensions of largest variance, dealt into pieces by
ranges and written as Parquet, a row for each block of BLOCK candidates, with the least and largest value of every dimension and of the label beside it: the zone map. Zone maps are read without
the blocks (column pruning).

An anchor's score against a block lies between two sums over the dimensions, of the least and the largest product of its component with the block's interval; both
are products of matrices, for all anchors and blocks at once. They decide twice what is read: first for the positives (blocks that have the label, whose upper bound reaches the
n-th best score that the anchor has in its own block), then for the negatives (blocks that have another label, whose bounds meet the window of one of the anchor's positives). Zone maps of
pieces choose which pieces meet which page of anchors (PAGE of them, in the order of the curve); within the task zone maps of blocks choose again, in the order of their upper bounds, and a block that can't
enter the best ones found so far is passed over. All bounds include ties, so results are exact.

Zone maps and anchors meet in groups of ZONES pieces by PAGES pages, anchors and blocks in pairs of a page and a piece (a piece has MOST_BLOCKS blocks at most): the
query set is stated, and no task holds more. The best of each pair are ranked by anchor or window in a window that prunes before the shuffle.

Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part. Equal rows (id, label, components) are one; rows of the anchor's own id are not
its candidates; rows of one id that differ are candidates and anchors each. Anchors meet candidates of their own length of vector only. Scores beyond 64 bits are an error. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, prepare, stored

SCALE = 256
BLOCK = 512
#: Blocks of a piece: as few as this, more as the table grows beyond MOST_PIECES pieces, MOST_BLOCKS at most.
LEAST_BLOCKS, MOST_BLOCKS, MOST_PIECES = 8, 128, 4096
#: Dimensions of the Hilbert curve and bits of each.
HILBERT, BITS = 8, 7
#: Anchors of a page, of which as many as ANCHORS meet a block at once; zone maps and pages that one task holds when they are compared.
PAGE, ANCHORS = 16_384, 4096
ZONES, PAGES = 4096, 2
#: Whole numbers up to this are exact in double precision.
_EXACT = 2.0**53


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (n, dimensions) of whole numbers of so many bits: coordinates are brought to the transposed form, whose bits are then interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flips ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: in double precision where every partial sum is exact in it, else in whole numbers of any size."""
    if a.size and b.size and np.abs(a).sum(axis=1).max() * np.abs(b).max() >= _EXACT:
        return (np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of a with vectors between low and high, a little wider than rounding can be wrong."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def whole_components(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, q): the rows that take part, each once."""
    q = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").alias("x"), q.alias("q"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").filter(finite).select("vec_id", "label", "q").dropDuplicates()


def _spreads(rows: DataFrame) -> DataFrame:
    """By length of vector: n, and of each dimension sum, sum of squares, least and largest; added up in the tasks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list] = {}
        for batch in it:
            column = batch.column(0)
            lengths = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                m = flat[(at[own][:, None] + np.arange(size)).ravel()].reshape(-1, size)
                new = [len(m), m.sum(axis=0), (m * m).sum(axis=0), m.min(axis=0), m.max(axis=0)]
                old = told.get(size)
                told[size] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        if told:
            columns = zip(*((size, t[0], *(x.tolist() for x in t[1:])) for size, t in told.items()), strict=True)
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["size", "n", "s", "ss", "low", "high"])

    parts = rows.select("q").mapInArrow(batches, "size long, n long, s array<double>, ss array<double>, low array<double>, high array<double>")
    each = parts.select("size", "n", F.posexplode(F.arrays_zip("s", "ss", "low", "high")).alias("i", "t"))
    return each.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("t.s").alias("s"), F.sum("t.ss").alias("ss"), F.min("t.low").alias("low"), F.max("t.high").alias("high"))


def _curve(spreads: DataFrame) -> tuple[int, list[tuple[int, float, float]]]:
    """The most frequent length of vector, and of its dimensions of largest variance number, least and largest: HILBERT rows."""
    variance = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    first = spreads.orderBy(F.desc("n"), "size", F.desc(variance), "i").select("size", "i", "low", "high").limit(HILBERT).collect()
    return (first[0][0], [(r[1], r[2], r[3]) for r in first if r[0] == first[0][0]]) if first else (0, [])


def _with_places(rows: DataFrame, size: int, dims: list[tuple[int, float, float]]) -> DataFrame:
    """rows with size and `place`, the place on the curve; 0 for vectors of another length."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            place, own = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths == size)
            if len(own) and dims:
                cells = [np.clip((flat[at[own] + i] - low) * ((1 << BITS) / max(high - low, 1e-300)), 0, (1 << BITS) - 1) for i, low, high in dims]
                place[own] = hilbert_keys(np.stack(cells, axis=1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.array(place)], names=["vec_id", "label", "q", "size", "place"])

    return rows.mapInArrow(batches, "vec_id long, label long, q array<double>, size long, place long")


_BLOCK = "piece long, block long, size long, label_low long, label_high long, low array<double>, high array<double>, ids array<long>, labels array<long>, q array<double>"


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """A row a block: piece, block (its number within the piece), zone map, and ids, labels and components of its candidates; written and read again."""
    size, dims = _curve(_spreads(rows))
    n = rows.count()
    blocks = -(-n // BLOCK)
    pieces = max(1, -(-blocks // min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-blocks // MOST_PIECES)))))
    order = ["size", "label", "place", "vec_id"]

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            sizes = table.column("size").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):  # a block has one length of vector
                own = table.slice(a, z - a)
                q, labels = _matrix(own, "q"), own.column("label").to_numpy()
                values = (piece, number, int(sizes[a]), int(labels.min()), int(labels.max()), q.min(axis=0), q.max(axis=0), own.column("vec_id").to_numpy(), labels, q.ravel())
                kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])
                number += 1

        for batch in it:
            at = 0
            while at < batch.num_rows:
                own = batch.slice(at, BLOCK - n_held)
                held, n_held, at = [*held, own], n_held + own.num_rows, at + own.num_rows
                if n_held == BLOCK:
                    yield from packed(pa.Table.from_batches(held))
                    held, n_held = [], 0
        if n_held:
            yield from packed(pa.Table.from_batches(held))

    placed = _with_places(rows, size, dims).repartitionByRange(pieces, *order).sortWithinPartitions(*order, "q")
    return stored(placed.mapInArrow(pack, _BLOCK))


_ANCHOR = "piece long, anchor long, vec_id long, label long, size long, q array<double>, least double"


def _anchors(blocks: DataFrame, is_anchor: Callable[[np.ndarray], np.ndarray], n: int) -> DataFrame:
    """The anchors, numbered in the order of the blocks, with page and the n-th best score of their label in their own block (-inf if it has fewer)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece, number, size, ids, labels, flat in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), *(batch.column(i) for i in (3, 4, 5)), strict=True):
                ids, labels, q = ids.values.to_numpy(), labels.values.to_numpy(), flat.values.to_numpy().reshape(-1, size)
                own = np.flatnonzero(is_anchor(ids))
                if not len(own):
                    continue
                least = np.full(len(own), -np.inf)
                score = exact_products(q[own], q).astype(np.float64)
                score[(labels[own][:, None] != labels) | (ids[own][:, None] == ids)] = -np.inf
                if len(ids) >= n:
                    least = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
                k = len(own)
                columns = [pa.array([piece] * k, pa.int64()), pa.array(((piece * MOST_BLOCKS * 64 + number) * BLOCK + own).astype(np.int64)), pa.array(ids[own]), pa.array(labels[own]), pa.array([size] * k, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(q[own].ravel()), size).cast(pa.list_(pa.float64())), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ANCHOR.split(", ")])

    found = stored(blocks.select("piece", "block", "size", "ids", "labels", "q").mapInArrow(batches, _ANCHOR))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    offsets = found.groupBy("piece").count().select("piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("piece").orderBy("anchor")) - 1
    return found.join(offsets, "piece").withColumn("page", F.floor(number / PAGE)).drop("piece", "offset")


_ZONE = ["piece", "size", "label_low", "label_high", "low", "high"]


def _zones(blocks: DataFrame) -> DataFrame:
    """Zone maps of pieces, one for each length of vector in it."""
    each = blocks.select("piece", "size", "label_low", "label_high", F.posexplode(F.arrays_zip("low", "high")).alias("i", "t"))
    joined = each.groupBy("piece", "size", "i").agg(F.min("t.low").alias("low"), F.max("t.high").alias("high"), F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "low", "high")))
    return joined.groupBy("piece", "size").agg(F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"), ordered.alias("t")).select("piece", "size", "label_low", "label_high", F.col("t.low").alias("low"), F.col("t.high").alias("high"))


def _by_size(anchors: pa.Table, others: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table]]:
    if not anchors.num_rows or not others.num_rows:
        return
    sizes = anchors.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        met = np.flatnonzero(others.column("size").to_numpy() == size)
        if len(met):
            own = np.flatnonzero(sizes == size)
            yield size, anchors.take(own) if len(own) < len(sizes) else anchors, others.take(met) if len(met) < others.num_rows else others


def _wanted(anchors: pa.Table, zones: pa.Table, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors want which zones, and the upper bounds. windows: other labels and the anchors' windows, else the own label from `least` on."""
    q, label = _matrix(anchors, "q"), anchors.column("label").to_numpy()[:, None]
    low, high = bounds(q, _matrix(zones, "low"), _matrix(zones, "high"))
    first, last = zones.column("label_low").to_numpy(), zones.column("label_high").to_numpy()
    if not windows:
        return (first <= label) & (label <= last) & (high >= anchors.column("least").to_numpy()[:, None]), high
    meets = np.zeros(high.shape, bool)
    above, below = _matrix(anchors, "window_low"), _matrix(anchors, "window_high")
    for k in range(above.shape[1]):
        meets |= (high >= above[:, k, None]) & (low <= below[:, k, None])
    return ((first != label) | (last != label)) & meets, high


def _meetings(anchors: DataFrame, zones: DataFrame, windows: bool) -> DataFrame:
    """(page, piece): which pages and pieces must meet, as zone maps of pieces tell."""
    most = lambda t, c: t.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
    pages, parts = most(anchors, "page") // PAGES + 1, most(zones, "piece") // ZONES + 1
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))

    def choose(a: pa.Table, z: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), np.int64)]
        for _, own, met in _by_size(a, z):
            wanted, _ = _wanted(own, met, windows)
            i, j = np.nonzero(wanted)
            found.append(np.unique(np.stack([own.column("page").to_numpy()[i], met.column("piece").to_numpy()[j]], axis=1), axis=0))
        pairs = np.concatenate(found)
        return pa.table({"page": pa.array(pairs[:, 0]), "piece": pa.array(pairs[:, 1])})

    left = anchors.withColumn("i", F.floor(F.col("page") / PAGES)).withColumn("j", each(parts)).groupBy("i", "j")
    right = zones.select(*_ZONE).withColumn("j", F.floor(F.col("piece") / ZONES)).withColumn("i", each(pages)).groupBy("i", "j")
    return left.cogroup(right).applyInArrow(choose, "page long, piece long").distinct()


def _top(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n first of each owner: highest score, then smallest id."""
    order = np.lexsort((ids, -score, owner))
    starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < n]


_FOUND = "anchor long, slot int, vec_id long, score long"


def _search(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, n: int, windows: bool) -> DataFrame:
    """(anchor, slot, vec_id, score, rank): the first n of each anchor (slot 0) or of each of its windows (slot: the positive's number)."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        for size, own, met in _by_size(a, b):
            q, label, vec_id = _matrix(own, "q"), own.column("label").to_numpy(), own.column("vec_id").to_numpy()
            wanted, high = _wanted(own, met, windows)
            if windows:
                above, below = _matrix(own, "window_low").copy(), _matrix(own, "window_high")
            else:
                least = own.column("least").to_numpy()
                above = np.where(np.isinf(least), np.iinfo(np.int64).min, least).astype(np.int64)[:, None]
                below = np.full((len(q), 1), np.iinfo(np.int64).max)
            slots = above.shape[1]
            best = [np.zeros(0, np.int64) for _ in range(3)]  # owner (anchor times slots plus slot), score, id
            for j in np.argsort(-high.max(axis=0), kind="stable").tolist():
                every = np.flatnonzero(wanted[:, j] & (high[:, j, None] >= above).any(axis=1))
                ids, labels = met.column("ids")[j].values.to_numpy(), met.column("labels")[j].values.to_numpy()
                vectors = met.column("q")[j].values.to_numpy().reshape(-1, size)
                for at in range(0, len(every), ANCHORS):
                    rows = every[at : at + ANCHORS]
                    score = exact_products(q[rows], vectors)
                    fits = (labels != label[rows][:, None]) if windows else (labels == label[rows][:, None])
                    fits &= ids != vec_id[rows][:, None]
                    fits &= (score >= above[rows].min(axis=1)[:, None]) & (score <= below[rows].max(axis=1)[:, None])
                    i, c = np.nonzero(fits)
                    s = score[i, c]
                    for slot in range(slots):
                        keep = np.flatnonzero((s >= above[rows[i], slot]) & (s <= below[rows[i], slot]))
                        new = rows[i[keep]] * slots + slot, s[keep], ids[c[keep]]
                        kept = _top(*new, n)
                        best = [np.concatenate([x, y[kept]]) for x, y in zip(best, new, strict=True)]
                kept = _top(*best, n)
                best = [x[kept] for x in best]
                owners, counts = np.unique(best[0], return_counts=True)
                full, ends = counts == n, np.cumsum(counts) - 1  # the last of each owner is its least
                spot = owners[full] // slots, owners[full] % slots
                above[spot] = np.maximum(above[spot], best[1][ends[full]])
            if len(best[0]):
                out.append([own.column("anchor").to_numpy()[best[0] // slots], best[0] % slots, best[2], best[1]])
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(4)]
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "slot", "vec_id", "score"])

    left = anchors.join(pairs, "page").groupBy("page", "piece")
    right = blocks.join(pairs, "piece").groupBy("page", "piece")
    found = left.cogroup(right).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Callable[[np.ndarray], np.ndarray],
    n_positives: int = 5,
    n_negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's first n_positives rows of its label the first n_negatives rows of other
    labels with least_percent to most_percent of the positive's score. is_anchor tells of an array of ids which are anchors'."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = cut(whole_components(vectors, vec_id, vector, F.col("label") if label is None else label))
    blocks = candidate_blocks(rows)
    zones = cut(_zones(blocks))
    anchors = stored(_anchors(blocks, is_anchor, n_positives))
    positives = stored(_search(anchors, blocks, _meetings(anchors, zones, False), n_positives, False))
    floor = lambda x: f"((({x}) - pmod({x}, 100)) div 100)"
    window = F.struct("rank", F.expr(f"-{floor(f'-{least_percent} * score')}").alias("low"), F.expr(floor(f"{most_percent} * score")).alias("high"))
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w"))  # n_positives entries at most
    never = lambda x: F.array_repeat(F.lit(x).cast("long"), F.lit(n_positives) - F.size("w"))
    asked = stored(anchors.join(windows, "anchor").select(*anchors.columns, F.concat(F.col("w.low"), never((1 << 63) - 1)).alias("window_low"), F.concat(F.col("w.high"), never(-(1 << 63) + 1)).alias("window_high")))
    negatives = _search(asked, blocks, _meetings(asked, zones, True), n_negatives, True)
    named = positives.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = negatives.join(named, ["anchor", "slot"])
    return both.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
