"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node with an edge (columns a and b).

    Each round writes the edges, a row for each node but the roots in the end, as Parquet to the checkpoint folder, so that the next plan has their true size; only their number and whether they changed
    comes to the driver. Rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        small = stored(small.filter("a > b").distinct())
        done = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges)
        edges = small
        if done:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
