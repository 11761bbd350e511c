"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source is to have a share of all words by its weight, but no more than most_epochs times its own words. Sources that a level of words for each unit of
weight would fill are clamped at that, what they leave is dealt out again by weight, until no other is filled: one aggregation over the table of
sources a round, of which a row comes to the driver.

A source's documents then have each as many whole repetitions as fit its target. What is left of the target goes to its documents in the order of a digest of seed and key:
each has one repetition more, the one in which the target is reached a fraction of one (its first words), all after it none. So a source's words are its target, rounded.
Documents are counted into buckets by digest; only those in the bucket in which a source's target is reached (and rows alike in key, if they are many) are sorted,
in pieces by ranges with offsets of the pieces' sums. Only key, source, size and digest are written and shuffled, never texts.

Null text has no words. A null source is a source, the last; a null key is a key. Rows alike in key and source are taken by size, equal ones in any order (they give equal
rows). A source without words has target 0. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, prepare, stored

WORD = r"[^\x20\x09-\x0D]+"
#: 13 hexadecimal digits of a digest: 52 bits.
_DIGITS, _BITS = 13, 52
#: Documents that a bucket has about, and the most bits that name a bucket.
BUCKET_ROWS = 4096
MOST_BITS = 20
#: Names sort as sources do, by code point, null last.
_NULL = "t"


def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(_NULL))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _cyclic(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """sources with `weight`: the weights in turn, in the order of the names. Ranks are by ranges, so that no task has all sources."""
    pieces = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sources.repartitionByRange(pieces, "name").withColumn("piece", F.spark_partition_id()))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    offsets = ranged.groupBy("piece").count().select("piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("piece").orderBy("name")) - 1
    own = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    return ranged.join(offsets, "piece").withColumn("weight", own).drop("piece", "offset")


def water_filled(sources: DataFrame, total: float) -> DataFrame:
    """sources (cap, weight) with `target`: together total, or all caps if that is less; by weight where no cap is in the way."""
    filled = lambda level: F.col("cap") <= F.lit(level) * F.col("weight")
    level, known = 0.0, -1
    while True:
        over = filled(level)
        row = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        clamped, taken, weight = row[0], row[1] or 0.0, row[2] or 0.0
        if clamped == known or not weight:
            break
        known, level = clamped, (total - taken) / weight
    left = F.lit(total - taken) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
    return sources.withColumn("target", F.when(over, F.col("cap")).otherwise(F.least(left, "cap")))


def _running(rows: DataFrame, pieces: int) -> DataFrame:
    """rows with `before`: the sizes of the rows before them in their source, from the first of their bucket on."""
    ranged = cut(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(pieces, "name", "digest", "size", "key", "row").withColumn("piece", F.spark_partition_id()))
    sums = ranged.groupBy("name", "piece").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("name", "piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("name", "piece").orderBy("digest", "size", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(offsets, ["name", "piece"]).withColumn("before", F.col("offset") + F.col("within"))


def mix_sources(documents: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.0, most_epochs: float = 3.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target (its source's words) and taken (words of it that the mix takes).

    weights: given to the sources in turn, or a table (source, weight), where a source without one has 0. The mix has share times the words of all documents.
    """
    spark = documents.sparkSession
    prepare(spark)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = F.col(f"`{key}`")
    label = F.coalesce(F.concat(F.lit("k"), given.cast("string")), F.lit("null"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), label)), 1, _DIGITS), 16, 10).cast("long")
    thin = stored(documents.select(given.alias("key"), _name(F.col(f"`{source}`")).alias("name"), word_count(F.col(f"`{text}`")).alias("size"), digest.alias("digest")))

    sums = cut(thin.groupBy("name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    total, rows = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if isinstance(weights, DataFrame):
        weighted = sums.join(weights.select(_name(F.col("source")).alias("name"), F.col("weight").cast("double").alias("weight")), "name", "left").fillna(0.0, ["weight"])
    else:
        weighted = _cyclic(sums, weights)
    weighted = cut(weighted.withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")))
    aimed = water_filled(weighted, total * share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aimed = aimed.select("name", "source_size", "target", whole.alias("whole"), F.greatest(F.floor(F.col("target") + 0.5) - whole * F.col("source_size"), F.lit(0)).alias("extra"))

    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, rows / BUCKET_ROWS)))))
    bucket = F.shiftright("digest", _BITS - bits)
    counted = thin.groupBy("name", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = counted.withColumn("lower", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).join(aimed.select("name", "extra"), "name")
    reached = upto.filter((F.col("lower") <= F.col("extra")) & (F.col("lower") + F.col("sum") > F.col("extra"))).select("name", F.col("bucket").alias("last"), "lower")
    level = stored(aimed.join(reached, "name", "left").withColumn("last", F.coalesce("last", F.lit(1 << bits))))

    both = thin.withColumn("bucket", bucket).join(level, "name")
    sure = both.filter("bucket <> last").withColumn("more", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0))
    at = _running(both.filter("bucket = last"), pieces)
    at = at.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("extra") - F.col("lower") - F.col("before"))))
    columns = [F.col("key").alias(key), F.when(F.col("name") != _NULL, F.substring("name", 2, 1 << 30)).alias(source), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")]
    return sure.select(*columns).unionByName(at.select(*columns))


def repetitions(documents: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: documents as often as they are taken, with `repetition` from 0; of a fraction the first words, joined by blanks. Keys are each once in both tables."""
    plan = mixed.filter("taken > 0").select(key, F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    each = documents.join(plan, key).withColumn("repetition", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__taken") / F.col("__size")) - 1)))
    left = F.col("__taken") - F.col("repetition") * F.col("__size")
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    kept = F.when(left >= F.col("__size"), F.col(f"`{text}`")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return each.withColumn(text, kept).drop("__size", "__taken")
