"""Greedy choices along an order: whether a row is taken depends on the earlier rows of its group that were taken."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.checkpoints import stored
from ..sources.workers import importable
from .similarity import BLOCK, MOST_BYTES, SPREAD, TILE, _matrix
from .windows import numbered

#: Whether a row is taken, by the cosine to the nearest earlier row of its group that was taken and the share of words in common with it (0 and 0 without one).
Accept = Callable[[float, float], bool]

#: Rows of a block that are settled one after another between two products of matrices.
STEP = 256

_NEAREST = "id bigint, score double, place bigint, words array<string>"
_VERDICT = "group bigint, id bigint, place bigint, of bigint, v array<double>, words array<string>, fresh boolean"
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def _empty(schema: str) -> pa.Table:
    return pa.schema([pa.field(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))]).empty_table()


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _nearest_of(v: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of v its largest cosine above 0 to one of `taken`, and the first with that (0 and -1 without one), tile by tile."""
    best, which = np.zeros(len(v)), np.full(len(v), -1)
    for a in range(0, len(v), TILE):
        for b in range(0, len(taken), TILE):
            scores = v[a : a + TILE] @ taken[b : b + TILE].T
            at = scores.argmax(axis=1)
            score = scores[np.arange(len(at)), at]
            more = np.flatnonzero(score > best[a : a + TILE])
            best[a + more], which[a + more] = score[more], b + at[more]
    return best, which


def _choose(rows: pa.Table, accept: Accept) -> pa.Table:
    """The rows of one group that are taken, going by place. Of equally near rows the earliest counts; those before the block (score, words of the nearest) are earlier than all in it.
    `fresh` is what later rows have to meet: a taken row whose vector no row before has that was taken (`known`: one before the block).

    STEP rows at a time meet all that were taken in the block by one product; only among themselves they are settled row by row."""
    rows = rows.sort_by([("place", "ascending"), ("id", "ascending")])
    v, n = _matrix(rows.column("v")), rows.num_rows
    words = [set(w or ()) for w in rows.column("words").to_pylist()]
    before = [x or 0.0 for x in rows.column("score").to_pylist()]
    their, forced, known, of = (rows.column(c).to_pylist() for c in ("their", "forced", "known", "of"))
    met, members, seen = np.zeros((64, v.shape[1])), [], set()  # vectors and row numbers of the fresh ones
    taken, fresh = np.zeros(n, bool), np.zeros(n, bool)
    for a in range(0, n, STEP):
        own = v[a : a + STEP]
        scores, new = own @ own.T, np.zeros(len(own), bool)
        near, which = _nearest_of(own, met[: len(members)])
        for k in range(len(own)):
            i = a + k
            best, with_words = before[i], their[i]
            if near[k] > best:
                best, with_words = float(near[k]), words[members[which[k]]]
            if new.any():
                within = np.where(new[:k], scores[k, :k], -1.0)
                if within[j := int(within.argmax())] > best:
                    best, with_words = float(within[j]), words[a + j]
            taken[i] = forced[i] or accept(best, _overlap(words[i], set(with_words or ())) if best > 0 else 0.0)
            if taken[i] and not known[i] and of[i] not in seen:
                seen.add(of[i])
                new[k] = fresh[i] = True
        at = np.flatnonzero(new)
        while len(members) + len(at) > len(met):
            met = np.concatenate([met, np.zeros_like(met)])
        met[len(members) : len(members) + len(at)] = own[at]
        members += (a + at).tolist()
    return rows.select(["group", "id", "place", "of", "v", "words"]).append_column("fresh", pa.array(fresh)).filter(pa.array(taken))


def _nearest(asked: pa.Table, taken: pa.Table) -> pa.Table:
    """For each row asked the nearest of the taken ones with a cosine above 0, the earliest of equal ones."""
    if not asked.num_rows or not taken.num_rows:
        return _empty(_NEAREST)
    taken = taken.sort_by("place")
    best, which = _nearest_of(_matrix(asked.column("v")), _matrix(taken.column("v")))
    some = np.flatnonzero(which >= 0)
    at = which[some]
    return pa.table([asked.column("id").take(some).cast(pa.int64()), pa.array(best[some]), taken.column("place").take(at).cast(pa.int64()), taken.column("words").take(at)], names=["id", "score", "place", "words"])


def taken_greedily(rows: DataFrame, accept: Accept, block: int = BLOCK) -> DataFrame:
    """(id) of the rows that are taken, going through each group by place; those that are `forced` always are.

    rows: group, id (each once), place (whole numbers), v, words (array<string>), forced. Larger groups are cut into blocks along the order (`block` rows at least, SPREAD blocks for the largest group until
    they have MOST_BYTES of vectors) and settled block after block, all large groups at once: the rows of a block meet those taken in the blocks before, in some SPREAD tasks, and are then settled with what
    they found, a group in a task. So rounds and copies of a row don't grow with the table, however rows depend on each other; each round writes what it took, and its plan starts from files. Groups of
    one block at most are settled in one task, many small ones together. Of taken rows with equal vectors later rows meet the first alone, as it comes first among equally near ones.
    """
    importable(rows.sparkSession)
    fixed = rows.select(F.col("group").cast("long"), F.col("id").cast("long"), F.col("place").cast("long"), unit(F.col("v").cast("array<double>")).alias("v"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.col("forced").alias("forced"))
    sizes = fixed.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sized = stored(fixed.join(sizes, "group"))
    most, dimensions = sized.agg(F.max("n"), F.max(F.size("v"))).first()
    pack, block = block, max(block, min(-(-(most or 0) // SPREAD), MOST_BYTES // (8 * (dimensions or 1))))
    nothing = [F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<string>").alias("their"), F.lit(False).alias("known")]

    def told(part: DataFrame) -> DataFrame:
        """With `of`: one name for all rows of a group that have the same vector."""
        return part.join(part.groupBy("group", "v").agg(F.min("id").alias("of")), ["group", "v"]).select(*fixed.columns, "of")

    def settled(of_one: pa.Table) -> pa.Table:
        groups = of_one.column("group").to_numpy()
        order = np.argsort(groups, kind="stable")
        own = [_choose(of_one.take(at), accept) for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(at)]
        return pa.concat_tables(own) if own else _empty(_VERDICT)

    small = sized.filter(F.col("n") <= block)
    packs = max(1, -(-small.count() // pack))
    found = told(small).select("*", *nothing, F.pmod(F.xxhash64("group"), F.lit(packs)).alias("pack")).groupBy("pack").applyInArrow(settled, _VERDICT)
    taken = [stored(found.select("id"))]

    large = sized.filter(F.col("n") > block)
    if not large.isEmpty():
        placed = numbered(told(large), "number", F.col("place"), F.col("id"), group="group")
        placed = stored(placed.withColumn("block", F.floor((F.col("number") - 1) / block)).drop("number"), "block")
        done: list[DataFrame] = []
        among = lambda paths: rows.sparkSession.read.schema(_VERDICT).parquet(*paths)
        for k in range(placed.agg(F.max("block")).first()[0] + 1):
            own = placed.filter(F.col("block") == k).drop("block")
            if done:
                met = among(d.stored_at for d in done).filter("fresh")
                packs = met.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("packs")).withColumn("pieces", F.ceil(F.lit(SPREAD) / F.col("packs")))
                dealt = own.select("group", "id", "v").join(packs, "group").withColumn("i", F.pmod(F.xxhash64("id"), "pieces")).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "packs")))
                against = met.join(packs, "group").withColumn("j", 1 + F.pmod(F.xxhash64("id"), "packs")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
                both = dealt.select("group", "i", "j", "id", "v").groupBy("group", "i", "j").cogroup(against.select("group", "i", "j", "place", "v", "words").groupBy("group", "i", "j"))
                best = both.applyInArrow(_nearest, _NEAREST).groupBy("id").agg(F.max_by(F.struct("score", F.col("words").alias("their")), F.struct("score", -F.col("place"))).alias("b")).select("id", "b.*")
                known = met.select("group", "of", F.lit(True).alias("known"))
                own = own.join(best, "id", "left").join(known, ["group", "of"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
            else:
                own = own.select("*", *nothing)
            done.append(stored(own.groupBy("group").applyInArrow(settled, _VERDICT)))
        taken.append(among(d.stored_at for d in done).select("id"))
    return taken[0].unionByName(taken[1]) if len(taken) > 1 else taken[0]
