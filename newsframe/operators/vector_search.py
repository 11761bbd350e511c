"""Searches over vectors that belong to assets: top-k, fusion of several queries, co-occurrence, pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.vectors import cosine, unit
from ..sources.checkpoints import cut, stored
from .graph import components
from .greedy import taken_greedily
from .joins import band_masks, keep_first_near
from .similarity import BLOCK, similar_pairs
from .windows import best_per_key, second_entity_best

#: Bands whose agreement is one key of a stored index, and folders for the values of each.
BANDS_TOGETHER, BAND_FOLDERS = 2, 16
#: Queries of one search that the plan holds as literals.
MOST_QUERIES = 1000


def _literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def top_k(vectors: DataFrame, query: list[float], k: int, least: float = -1.0) -> DataFrame:
    """The k vectors with the highest cosine, at least `least`; scores with 4 decimals, ties by vec_id."""
    scored = vectors.select("vec_id", "asset_id", F.round(cosine(F.col("v"), _literal(query)), 4).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


def best_assets(vectors: DataFrame, score: Column, least: float, limit: int | None = None) -> DataFrame:
    """Each asset's best vector by a score."""
    return best_per_key(vectors.select("vec_id", "asset_id", F.round(score, 4).alias("score")), "asset_id", "score", "vec_id", least, limit)


def mean_vector(vectors: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: the weighted mean of all vectors, brought to length 1. Positions are aggregated, not whole vectors."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = vectors.select(w.alias("w"), F.posexplode("v").alias("i", "x"))
    means = parts.groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    mean = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return mean.select(unit(F.col("mean")).alias("mean"))


def fused_score(v: Column, queries: list[tuple[list[float], float]], method: str = "hybrid") -> Column:
    """Of several queries (vector, confidence): the cosine to their weighted mean ('average'), the largest cosine ('max'), or 0.7 and 0.3 of them ('hybrid')."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"{len(queries)} queries; search in blocks of {MOST_QUERIES}")
    total = sum(w for _, w in queries)
    mean = [sum(w * q[i] for q, w in queries) / total for i in range(len(queries[0][0]))]
    average = cosine(v, _literal(mean))
    each = [cosine(v, _literal(q)) for q, _ in queries]
    largest = F.greatest(*each) if len(each) > 1 else each[0]
    return {"average": average, "max": largest, "hybrid": 0.7 * average + 0.3 * largest}[method]


def _largest(asked: pa.Table, queries: pa.Table) -> pa.Table:
    """(row, largest): of each row the largest cosine to one of the queries of a block."""
    matrix = lambda t: np.array(t.column("v").to_pylist(), np.float64).reshape(t.num_rows, -1)
    some = asked.num_rows and queries.num_rows
    return pa.table({"row": asked.column("row") if some else pa.array([], pa.int64()), "largest": pa.array((matrix(asked) @ matrix(queries).T).max(axis=1) if some else [], pa.float64())})


def set_scores(vectors: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """vectors with `score`: 0.7 of the cosine to the mean of all queries and 0.3 of the largest cosine to one of them; no rows without queries.

    queries (v) are a table of any size: the mean is one row, and blocks of distinct queries meet blocks of vectors as matrix products, each of which gives a row a vector. The work is the
    number of vectors by the number of distinct queries.
    """
    rows = cut(vectors.filter("v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    asked = stored(queries.select("v").filter("v IS NOT NULL"))
    distinct = stored(asked.select(unit(F.col("v").cast("array<double>")).alias("v")).distinct())
    n, m = (max(1, -(-t.count() // block)) for t in (rows, distinct))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    dealt = rows.select("row", unit(F.col("v").cast("array<double>")).alias("v"), F.pmod(F.xxhash64("row"), F.lit(n)).alias("i")).withColumn("j", each(m))
    met = distinct.withColumn("j", F.pmod(F.xxhash64("v"), F.lit(m))).withColumn("i", each(n))
    found = dealt.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInArrow(_largest, "row long, largest double").groupBy("row").agg(F.max("largest").alias("largest"))
    scored = rows.join(found, "row").join(F.broadcast(mean_vector(asked)), F.lit(True))
    return scored.select(*vectors.columns, (0.7 * cosine(F.col("v"), F.col("mean")) + 0.3 * F.col("largest")).alias("score"))


def target_assets(vectors: DataFrame, score: Column, least: float) -> DataFrame:
    """Vectors beside the best one in assets whose best one reaches `least` (columns of vectors, target_score)."""
    best = best_assets(vectors, score, least).select("asset_id", F.col("vec_id").alias("target_id"), F.col("score").alias("target_score"))
    return vectors.join(best, "asset_id").filter(F.col("vec_id") != F.col("target_id"))


def merge_groups(members: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(vec_id, group_id) after groups whose mean vectors have cosine `threshold` or more are joined, again and again until none are.

    members: vec_id, group_id, v. Each round joins all such groups at once, so that the order of groups doesn't matter; a merged group has the smallest number.
    """
    members = stored(members.select("vec_id", "group_id", "v"))
    while True:
        parts = members.select("group_id", F.posexplode(unit(F.col("v"))).alias("i", "x")).groupBy("group_id", "i").agg(F.avg("x").alias("m"))
        means = parts.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
        pairs = stored(similar_pairs(means, threshold, "group_id", "v"))
        if pairs.isEmpty():
            return members.select("vec_id", "group_id")
        roots = components(pairs.select("a", "b")).withColumnRenamed("node", "group_id")
        members = stored(members.join(roots, "group_id", "left").select("vec_id", F.coalesce("root", "group_id").alias("group_id"), "v"))


def co_occurrence(others: DataFrame, groups: DataFrame, near: float = 0.95) -> DataFrame:
    """Groups of vectors that come with the target in two assets or more: vectors, assets, the representative with the highest target score; numbered by assets.

    groups: (vec_id, group_id). An asset's first vector (by vec_id) counts for it; a group's vectors that are nearer than `near` to an earlier one that counts don't.
    """
    one = others.join(groups, "vec_id").groupBy("group_id", "asset_id").agg(F.min_by(F.struct("vec_id", "target_score", "v"), "vec_id").alias("r")).select("group_id", "asset_id", "r.*")
    one = stored(one)
    rows = one.select(F.col("group_id").alias("group"), F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), "v", F.array().cast("array<string>").alias("words"), F.lit(False).alias("forced"))
    kept = one.join(taken_greedily(rows, lambda score, _: score <= near).withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    counted = kept.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_assets"), F.min_by("vec_id", F.struct(-F.col("target_score"), "vec_id")).alias("representative"))
    return counted.filter("n_assets >= 2").orderBy(F.desc("n_assets"), "group_id")


def nearest_label(vectors: DataFrame, labels: list[tuple[str, list[float]]], least: float = 0.45) -> DataFrame:
    """The label of the nearest labelled vector, null below `least`. The labels are the stated query set, MOST_QUERIES at most."""
    if len(labels) > MOST_QUERIES:
        raise ValueError(f"{len(labels)} labels; search in blocks of {MOST_QUERIES}")
    scores = F.array(*(F.struct(F.round(cosine(F.col("v"), _literal(v)), 4).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("label")) for i, (name, v) in enumerate(labels)))
    best = F.array_max(scores)
    return vectors.select("vec_id", best["score"].alias("score"), F.when(best["score"] >= least, best["label"]).alias("label"))


def pair_search(vectors: DataFrame, score_a: Column, score_b: Column, least: float, limit: int) -> DataFrame:
    """Assets with one vector for A and another for B, both at `least` or above, by the sum of the scores."""
    scores = vectors.select("asset_id", "vec_id", F.round(score_a, 4).alias("score_a"), F.round(score_b, 4).alias("score_b"))
    both = second_entity_best(scores).filter((F.col("a_score") >= least) & (F.col("b_score") >= least))
    return both.withColumn("total", F.round(F.col("a_score") + F.col("b_score"), 4)).orderBy(F.desc("total"), "asset_id").limit(limit)


def unprocessed(all_items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return all_items.join(processed.select(key), key, "left_anti")


def index_metadata(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("asset_id").alias("n_assets"))


def build_index(items: DataFrame, index: DataFrame, processed: DataFrame, below: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, processed, metadata) after the items that were not processed yet: those whose fingerprint is not near that of an earlier one are added, all are marked.

    items and index: id, fp; new items have larger ids than those in the index. metadata: items processed now, added, skipped as near copies, and the size of the index.
    """
    new = cut(unprocessed(items, processed, "id").select("id", "fp"))
    stays = keep_first_near(index.select("id", "fp").unionByName(new), below=below)
    added = cut(new.join(stays, "id", "left_semi"))
    whole = index.select("id", "fp").unionByName(added)
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    counts = one(new, "n_new").join(F.broadcast(one(added, "n_added")), F.lit(True)).join(F.broadcast(one(whole, "n_index")), F.lit(True))
    return whole, processed.select("id").unionByName(new.select("id")), counts.withColumn("n_skipped", F.col("n_new") - F.col("n_added"))


_BANDS = "i int, part int, band long, id long, fp long"


def _banded(items: DataFrame, below: int) -> DataFrame:
    """(i, part, band, id, fp): the keys by which fingerprints of less than `below` bits apart meet, and the folder of each."""
    masks = band_masks(60, below, BANDS_TOGETHER)
    keyed = items.select("id", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in masks))).alias("i", "band"))
    return keyed.select("i", F.pmod(F.xxhash64("band"), F.lit(BAND_FOLDERS)).cast("int").alias("part"), "band", "id", "fp")


def extend_index(folder: str, items: DataFrame, below: int = 6) -> DataFrame:
    """(id, fp) of the items that are added to the index in folder: those of which neither one in the index nor an earlier added one is near. New ids are larger than those in the index.

    The index lies on disk by bands: a table of keys in folders by band and part of its values. Only the new items' keys are made, and only the folders that they fall into are read,
    so a build takes time with what is new and what it meets. What is added is appended.
    """
    spark = items.sparkSession
    path = f"{folder}/bands"
    new = stored(items.select("id", "fp").distinct())
    try:
        known = spark.read.schema(_BANDS).parquet(path)
    except AnalysisException:  # the first build
        known = spark.createDataFrame([], _BANDS)
    asked = stored(_banded(new, below))
    spots = asked.select("i", "part").distinct()  # of so many folders at most
    inside = known.join(F.broadcast(spots), ["i", "part"], "left_semi")
    old = inside.withColumnRenamed("fp", "old")
    met = asked.join(old.select("i", "band", "old"), ["i", "band"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("old"))) < below)
    fresh = stored(new.join(met.select("id").distinct(), "id", "left_anti"))
    added = stored(fresh.join(keep_first_near(fresh, below=below).select("id"), "id", "left_semi"))
    _banded(added, below).repartition("i", "part").write.mode("append").partitionBy("i", "part").parquet(path)
    return added
