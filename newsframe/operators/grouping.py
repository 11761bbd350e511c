"""Groups of vectors along an order: each vector joins the nearest group so far or starts one, then groups that have come near are merged.

The outcome depends on the order, as the groups' means move. Both steps are exact for the order and cut into tasks by what can't depend on each other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from ..sources.checkpoints import discard, stored
from ..sources.workers import importable
from .graph import components
from .similarity import BLOCK, MOST_BYTES, SPREAD, TILE, nearest_earlier, similar_labels, similar_pairs
from .windows import numbered


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def _near(threshold: float):
    """(near): the groups with a mean near to one of the rows asked."""

    def meet(asked: pa.Table, groups: pa.Table) -> pa.Table:
        found = np.zeros(groups.num_rows, bool)
        if asked.num_rows and groups.num_rows:
            v, means = _matrix(asked.column("v")), _matrix(groups.column("v"))
            for a in range(0, len(v), TILE):
                for b in range(0, len(means), TILE):
                    found[b : b + TILE] |= (v[a : a + TILE] @ means[b : b + TILE].T >= threshold).any(axis=0)
        return groups.select(["near"]).filter(pa.array(found))

    return meet


_STEP = "kind string, id long, near long, of long, n long, v array<double>"


def _join_in_order(threshold: float):
    """One block in its order. Rows of kind row (id: number, of: the first row with that vector), member (id, of: the first row with the vector of a nearest earlier row, score, near: the oldest group
    of that vector before the block, null if it comes in the block) and group (near, n, v: the sum of its members).
    Gives row (id, of, near: its group) and group for those that grew or are new; a group is named by the number of its first row."""

    def step(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        of = lambda kind: table.take(np.flatnonzero(kinds == kind))
        rows, known, members = of("row").sort_by("id"), of("group").sort_by("near"), of("member")
        names: list[int] = known.column("near").to_pylist()
        place = {g: k for k, g in enumerate(names)}
        v = _matrix(rows.column("v"))
        sums, counts = np.zeros((len(names) + 64, v.shape[1])), [*known.column("n").to_pylist()]
        if names:
            sums[: len(names)] = _matrix(known.column("v"))
        means = np.array([_unit(s) for s in sums])
        nearest: dict[int, list[tuple[int, float]]] = {}
        oldest: dict[int, int] = {}  # by vector
        for i, first, g, s in zip(*(members.column(c).to_pylist() for c in ("id", "of", "near", "score")), strict=True):
            nearest.setdefault(i, []).append((first, s))
            if g is not None:
                oldest[first] = place[g]
        numbers, firsts, own, grown = rows.column("id").to_pylist(), rows.column("of").to_pylist(), [], set()
        for i, number in enumerate(numbers):
            k, best = -1, 0.0
            if names:
                score = means[: len(names)] @ v[i]
                k = int(score.argmax())
                best = score[k]
            for first, s in nearest.get(number, ()):
                if s > best or (s == best and oldest[first] < k):
                    k, best = oldest[first], s
            if k < 0 or best < threshold or best <= 0:
                k = len(names)
                names.append(number)
                counts.append(0)
                if k == len(sums):
                    sums, means = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, means))
            own.append(k)
            oldest[firsts[i]] = min(k, oldest.get(firsts[i], k))
            sums[k] += v[i]
            counts[k] += 1
            means[k] = _unit(sums[k])
            grown.add(k)
        told = sorted(grown)
        columns = {
            "kind": ["row"] * len(v) + ["group"] * len(told),
            "id": [*numbers, *[None] * len(told)],
            "near": [*(names[k] for k in own), *(names[k] for k in told)],
            "of": [*firsts, *[None] * len(told)],
            "n": [*[None] * len(v), *(counts[k] for k in told)],
            "v": [*[None] * len(v), *(sums[k].tolist() for k in told)],
        }
        types = {"kind": pa.string(), "id": pa.int64(), "near": pa.int64(), "of": pa.int64(), "n": pa.int64(), "v": pa.list_(pa.float64())}
        return pa.table({name: pa.array(x, types[name]) for name, x in columns.items()})

    return step


def grouped_in_order(vectors: DataFrame, threshold: float = 0.35, place: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(vec_id, group_id): going by place, a vector joins the group with the largest cosine to its mean or to one of its members (of equal ones the oldest), if that is at least threshold, else starts one.
    group_id is the vec_id of a group's first vector. Vectors that stay alone are groups.

    Of a vector's cosines to members only the largest can decide, and which earlier vector that is doesn't depend on the groups; so the nearest earlier ones are found first, for all at once. Then blocks of
    the order (`block` rows at least, SPREAD of them until they have MOST_BYTES) are settled one after another. A block meets the groups' means in tasks of their own, which tell what reaches the threshold;
    one task goes through it with the groups that were told and those of the nearest earlier vectors, as no other can be joined in it. So a task holds a block and the groups near it.
    """
    importable(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col(place).alias("place"), unit(F.col("v").cast("array<double>")).alias("v")).filter("size(v) > 0")
    placed = stored(numbered(rows, "id", F.col("place"), F.col("vec_id")))
    n, dimensions = placed.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(block, min(-(-n // SPREAD), MOST_BYTES // (8 * (dimensions or 1))))
    within = F.floor((F.col("id") - 1) / block).alias("block")
    firsts = stored(placed.groupBy("v").agg(F.min("id").alias("of")))
    nearest = nearest_earlier(firsts, threshold, "of", "v").filter("score > 0").withColumnRenamed("earlier", "of")
    placed = stored(placed.join(firsts, "v").select("id", "vec_id", "of", "v", within), "block")
    copies = placed.filter("id > of").select("id", "of", dot(F.col("v"), F.col("v")).alias("score")).filter("score > 0")
    members = stored(nearest.select("id", "of", "score").unionByName(copies).select("*", within), "block")
    empty = vectors.sparkSession.createDataFrame([], "id long, near long, of long, n long, v array<double>")
    done, groups = empty.select("id", "of", "near"), empty.select("near", "n", "v")
    nothing = lambda kind: F.lit(None).cast(kind)
    shape = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), *((F.col(c) if c in rows.columns else nothing(t)).alias(c) for c, t in (("id", "long"), ("near", "long"), ("of", "long"), ("score", "double"), ("n", "long"), ("v", "array<double>"))))
    for k in range(-(-n // block)):
        own = placed.filter(F.col("block") == k).select("id", "of", "v")
        asked = members.filter(F.col("block") == k).select("id", "of", "score")
        parts = [shape(own, "row")]
        if k:
            asked = stored(asked.join(done.groupBy("of").agg(F.min("near").alias("near")), "of", "left"))
            packs = max(1, -(-groups.count() // block))
            pieces = max(1, SPREAD // packs)
            each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
            dealt = own.select("v", F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("i")).withColumn("j", each(packs))
            means = groups.select("near", unit(F.col("v")).alias("v"), F.pmod(F.xxhash64("near"), F.lit(packs)).alias("j")).withColumn("i", each(pieces))
            near = dealt.groupBy("i", "j").cogroup(means.groupBy("i", "j")).applyInArrow(_near(threshold), "near long")
            parts.append(shape(groups.join(near.unionByName(asked.select("near")).distinct(), "near", "left_semi"), "group"))
        parts.append(shape(asked, "member"))
        settled = stored(reduce(DataFrame.unionByName, parts).groupBy().applyInArrow(_join_in_order(threshold), _STEP))
        before = done, groups, asked, settled
        done = stored(done.unionByName(settled.filter("kind = 'row'").select("id", "of", "near")))
        grown = settled.filter("kind = 'group'").select("near", "n", "v")
        groups = stored(groups.join(grown.select("near"), "near", "left_anti").unionByName(grown))
        for old in before:  # all that is asked for from here on is in files of its own
            discard(old)
    names = placed.select(F.col("id").alias("near"), F.col("vec_id").alias("group_id"))
    return placed.select("id", "vec_id").join(done.select("id", "near"), "id").join(names, "near").select("vec_id", "group_id")


_TRACE = "kind string, root long, id long, into long, n long, v array<double>, near array<long>"


def _merge_pass(threshold: float):
    """One pass over the groups of a component, oldest first: each takes in, in order, every later one whose mean is near its own as it stands, or that has a member near one of its members.
    Gives group (id, into: the group that it is in now, and of those that stay n, v and near), and step: each mean that a group had on the way."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        root, ids, counts = table.column("root")[0].as_py(), table.column("id").to_pylist(), table.column("n").to_pylist()
        sums = _matrix(table.column("v")).copy()
        means = np.array([_unit(s) for s in sums])
        near = [set(x) for x in table.column("near").to_pylist()]
        alive, into = np.ones(len(ids), bool), list(range(len(ids)))
        steps: list[np.ndarray] = []
        place = {g: k for k, g in enumerate(ids)}
        for i in range(len(ids)):
            if not alive[i]:
                continue
            j = i + 1
            while j < len(ids):
                close = means[j:] @ means[i] >= threshold
                close[[place[g] - j for g in near[i] if g in place and place[g] >= j]] = True
                at = np.flatnonzero(close & alive[j:])
                if not len(at):
                    break
                j += int(at[0])
                sums[i] += sums[j]
                counts[i] += counts[j]
                means[i] = _unit(sums[i])
                steps.append(means[i].copy())
                near[i] |= near[j]
                for g in near[j]:  # what is near to the one taken in is near to the one that took it
                    if g in place:
                        near[place[g]].add(ids[i])
                alive[j], into[j] = False, i
                j += 1
        columns = {
            "kind": ["group"] * len(ids) + ["step"] * len(steps),
            "root": [root] * (len(ids) + len(steps)),
            "id": [*ids, *[None] * len(steps)],
            "into": [*(ids[into[k]] for k in range(len(ids))), *[None] * len(steps)],
            "n": [*(int(c) for c in counts), *[None] * len(steps)],
            "v": [*sums.tolist(), *(s.tolist() for s in steps)],
            "near": [*(sorted(x) for x in near), *[None] * len(steps)],
        }
        types = {"kind": pa.string(), "root": pa.int64(), "id": pa.int64(), "into": pa.int64(), "n": pa.int64(), "v": pa.list_(pa.float64()), "near": pa.list_(pa.int64())}
        return pa.table({name: pa.array(x, types[name]) for name, x in columns.items()})

    return merge


def merged_in_order(members: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(vec_id, group_id) after passes over the groups in the order of their group_id, until one merges nothing: in a pass each group takes in, one after another, the later ones whose
    mean has a cosine of threshold or more to its own, which moves, or that have a member with that cosine to one of its members. A merged group has the smaller group_id.

    members: vec_id, group_id, v. Groups that are near each other, by means or members, are a component and go through a pass in one task, a row a group. Where a mean that a group had on
    the way is near a group of another component, the two are one component and the pass is done again; so what is decided apart can't depend on each other.
    """
    importable(members.sparkSession)
    members = stored(members.select("vec_id", "group_id", unit(F.col("v").cast("array<double>")).alias("v")))
    names = members.select("vec_id", "group_id")
    ends = stored(similar_labels(members, threshold, "group_id"))  # pairs of groups, not of members
    both = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y")))
    near = both.groupBy(F.col("x").alias("id")).agg(F.collect_set("y").alias("near"))
    parts = members.select("group_id", F.posexplode("v").alias("i", "x")).groupBy("group_id", "i").agg(F.sum("x").alias("s"))
    sums = parts.groupBy(F.col("group_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("v"))
    counts = members.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(sums.join(counts, "id").join(near, "id", "left").select("id", "n", "v", F.coalesce("near", F.array().cast("array<long>")).alias("near")))
    into = members.select(F.col("group_id").alias("id")).distinct().withColumn("into", F.col("id"))
    while True:
        means = groups.select("id", unit(F.col("v")).alias("v"))
        edges = similar_pairs(means, threshold, "id", "v").select("a", "b").unionByName(groups.select(F.col("id").alias("a"), F.explode("near").alias("b")).join(groups.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
        edges = stored(edges)
        if edges.isEmpty():
            break
        while True:
            roots = stored(components(edges).withColumnRenamed("node", "id"))
            passed = stored(groups.join(roots, "id").groupBy("root").applyInArrow(_merge_pass(threshold), _TRACE))
            steps = passed.filter("kind = 'step'").select("root", unit(F.col("v")).alias("v")).withColumn("id", -1 - F.monotonically_increasing_id())
            rest = means.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), "v", "id")
            every = stored(steps.select("root", "v", "id").unionByName(rest))
            crossing = similar_pairs(every, threshold, "id", "v").join(every.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(every.select(F.col("id").alias("b"), F.col("root").alias("y")), "b").filter("x <> y")
            crossing = stored(crossing.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
            if crossing.isEmpty():
                break
            edges = stored(edges.unionByName(crossing))
        told = passed.filter("kind = 'group'")
        stay = told.filter("into = id").select("id", "n", "v", "near")
        renamed = told.filter("into <> id").select("id", F.col("into").alias("to"))
        if renamed.isEmpty():
            break
        groups = stored(groups.join(roots.select("id"), "id", "left_anti").unionByName(stay))
        into = stored(into.join(renamed.withColumnRenamed("id", "into"), "into", "left").select("id", F.coalesce("to", "into").alias("into")))
    return names.join(into.withColumnRenamed("id", "group_id"), "group_id").select("vec_id", F.col("into").alias("group_id"))
