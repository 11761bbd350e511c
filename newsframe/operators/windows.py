"""Ordered operators: cutoffs, first ones, latest ones, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut, stored

#: Pages that lie in one folder.
PAGES_A_SPAN = 1000


def best_per_key(rows: DataFrame, key: str, score: str, tie: str, least: float | None = None, limit: int | None = None) -> DataFrame:
    """The best row of each key (ties: the smallest `tie`), those at `least` and above, the best `limit` of them. By partial aggregation, not by a window."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col(score), tie)).alias("r")).select("r.*")
    if least is not None:
        best = best.filter(F.col(score) >= least)
    return best.orderBy(F.desc(score), tie).limit(limit) if limit else best


def until_consecutive_old(rows: DataFrame, group: str, order: str, old: Column, n: int = 3, pieces: int | None = None) -> DataFrame:
    """New rows of each group before its n-th old one in a row. old null (no date): the row is kept and doesn't count either way.

    The rows are dealt by ranges of group and order, so that a large group is many pieces. A piece tells with how many old ones in a row it ends and whether n come together
    in it; a row for each piece of a group goes through a window that hands the count on to the next piece.
    """
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.withColumn("__old", old).repartitionByRange(pieces, group, order).withColumn("__piece", F.spark_partition_id()))
    upto = Window.partitionBy(group, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy(group, "__piece", "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__island", F.count_if(F.col("__old") == F.lit(False)).over(upto)).withColumn("__in_row", F.count_if(F.col("__old")).over(run))

    first = F.col("__island") == 0
    told = local.groupBy(group, "__piece").agg(
        F.max("__island").alias("__news"),
        F.max_by("__in_row", order).alias("__tail"),
        F.coalesce(F.max(F.when(first, F.col("__in_row"))), F.lit(0)).alias("__lead"),
        F.coalesce(F.max(F.when(~first, F.col("__in_row"))), F.lit(0)).alias("__most"),
    )
    by_piece = Window.partitionBy(group).orderBy("__piece")
    told = told.withColumn("__since", F.sum((F.col("__news") > 0).cast("int")).over(by_piece))
    told = told.withColumn("__out", F.sum("__tail").over(Window.partitionBy(group, "__since").orderBy("__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    told = told.withColumn("__in", F.coalesce(F.lag("__out").over(by_piece), F.lit(0)))
    ends = (F.col("__lead") + F.col("__in") >= n) | (F.col("__most") >= n)
    told = told.withColumn("__over", F.coalesce(F.max(ends.cast("int")).over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    both = local.join(told.select(group, "__piece", "__in", "__over"), [group, "__piece"])
    ended = F.max((F.col("__in_row") + F.when(first, F.col("__in")).otherwise(0) >= n).cast("int")).over(upto)
    kept = both.withColumn("__ended", ended).filter("__over = 0 AND __ended = 0 AND NOT coalesce(__old, false)")
    return kept.select(rows.columns)


def numbered(rows: DataFrame, name: str, *order: Column, group: str | None = None, pieces: int | None = None) -> DataFrame:
    """rows with their number in the order, from 1, overall or in their group: a global order in which no task has all rows of a group.

    The rows are dealt by ranges of group and order into pieces, of which equal rows are in one; the pieces' counts, a row for each piece of a group, give the number before a piece, and rows are counted within it.
    """
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group] if group else []
    ranged = cut(rows.repartitionByRange(pieces, *keys, *order).withColumn("__piece", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(*order))
    joined = ranged.withColumn("__within", within).join(offsets, [*keys, "__piece"])
    return joined.select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))


def first_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct by key; of equal ones the first by position."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), position).alias("r")).select("r.*")


def last_n(rows: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The last n rows of each group. Spark prunes within partitions first, so a large group doesn't meet whole in one task."""
    w = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_of_each(rows: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` from 1, with the total and the number of pages beside each row. The rows up to it are the first of a sort; for pages far behind see pages()."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    own = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return own.join(F.broadcast(total), F.lit(True)).withColumn("pages", F.ceil(F.col("total") / size))


def pages(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """rows with `page`, from 1, and `number`, written once in a folder a range of pages: reading one page filters on `span` and reads that folder alone.

    A listing that is read more than once is laid out so in one range partitioning; page k is filter((span == (k - 1) // PAGES_A_SPAN) & (page == k)), which page_of() writes.
    """
    ranked = numbered(rows, "number", *order)
    paged = ranked.withColumn("page", F.floor((F.col("number") - 1) / size) + 1)
    return stored(paged.withColumn("span", F.floor((F.col("page") - 1) / PAGES_A_SPAN)), "span")


def page_of(listing: DataFrame, number: int) -> DataFrame:
    return listing.filter((F.col("span") == (number - 1) // PAGES_A_SPAN) & (F.col("page") == number)).drop("span")


def second_entity_best(scores: DataFrame) -> DataFrame:
    """(asset_id, a_id, a_score, b_id, b_score): of each asset the row best for A, and of its other rows the one best for B. Ties: the smaller vec_id."""
    first = scores.groupBy("asset_id").agg(F.min_by(F.struct("vec_id", "score_a"), F.struct(-F.col("score_a"), "vec_id")).alias("a"))
    rest = scores.join(first, "asset_id").filter(F.col("vec_id") != F.col("a.vec_id"))
    second = rest.groupBy("asset_id").agg(F.first("a").alias("a"), F.min_by(F.struct("vec_id", "score_b"), F.struct(-F.col("score_b"), "vec_id")).alias("b"))
    return second.select("asset_id", F.col("a.vec_id").alias("a_id"), F.col("a.score_a").alias("a_score"), F.col("b.vec_id").alias("b_id"), F.col("b.score_b").alias("b_score"))
