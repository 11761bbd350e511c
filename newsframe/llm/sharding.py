"""Rendezvous hashing of record keys over weighted shards, and gapless slots within each shard.

Each key draws a uniform number for every shard from a digest of key and shard; the shard with the least -ln(u) / weight
takes it. Key and shards decide alone, so one more shard takes rows only into itself. A row's slot is its rank within the shard by a digest
of its key, then size and checksum: a range partitioning on them deals the rows into ordered pieces of like size, the pieces' counts (a row for each
shard and piece) give offsets, and a window counts within a piece. Only key, size and checksum are shuffled.

Null keys are one key, told from all others. Rows of one key go to one shard, but are parted over pieces by size, checksum and a row number, so that a key with a third of
all rows is no task of its own; equal rows are ranked in any order. Null text counts as empty. An empty table gives an empty result; columns of the input are not looked at but key
and text. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, prepare

#: 13 hexadecimal digits: 52 bits, whole numbers in a double.
_DIGITS = 13


def _uniform(key: Column, shard: Column | int) -> Column:
    """Between 0 and 1, both excluded."""
    digest = F.md5(F.concat_ws("/", F.lit(str(shard)) if isinstance(shard, int) else shard.cast("string"), key))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a string key; a shard with weight 0 gets nothing."""
    costs = [F.struct((-F.log(_uniform(key, i)) / float(w)).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def shard_records(records: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """key, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot and grown_shard (with one more shard of the mean weight)."""
    spark = records.sparkSession
    prepare(spark)
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given, words = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("k"), given.cast("string")), F.lit("null"))
    grown = [*weights, sum(weights) / len(weights)]
    slim = records.select(given.alias("__key"), F.octet_length(words).cast("long") + 8, F.crc32(words.cast("binary")), name).toDF("__key", "size", "text_crc32", "name")
    dealt = slim.select("__key", "size", "text_crc32", rendezvous_shard(F.col("name"), weights).alias("shard"), rendezvous_shard(F.col("name"), grown).alias("grown_shard"), F.md5("name").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["digest", "size", "text_crc32", "row"]
    ranged = cut(dealt.repartitionByRange(pieces, "shard", *order).withColumn("piece", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "piece").count()
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "piece").orderBy(*order)
    ranked = ranged.withColumn("rank", F.row_number().over(within)).join(offsets, ["shard", "piece"])
    return ranked.select(F.col("__key").alias(key), "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")
