"""Event clusters: similarity components, refinement, assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_hash, truncated, word_set
from ..functions.vectors import cosine
from ..sources.readers import append_log
from .filters import recent_window
from .graph import components
from .greedy import taken_greedily
from .similarity import similar_links

#: When a candidate joins an accepted member, by cosine and by the share of headline words in common.
SURE_COSINE = 0.93
OVERLAP_RULES = ((0.10, None), (0.60, 0.75), (0.35, 0.80))
#: Fixed values: (least cosine, least overlap, verdict), the first that holds.
VERDICTS = ((0.80, 0.12, "PASS"), (0.68, 0.40, "PASS (headline)"), (0.92, 0.0, "PASS (content)"))
#: Texts that an encoder gets at once.
ENCODED_AT_ONCE = 32


def accepted(score: Column | float, overlap: Column | float, threshold: float) -> Column | bool:
    """Whether two articles tell of one event, of columns or of numbers."""
    rules = score >= SURE_COSINE
    for least_overlap, least_score in OVERLAP_RULES:
        rules = rules | ((overlap >= least_overlap) & (score >= (threshold if least_score is None else least_score)))
    return rules


def verdict(score: Column, overlap: Column) -> Column:
    """What a pair's cosine and headline overlap come to when encoders are compared."""
    found = F.lit("FAIL")
    for least_score, least_overlap, name in reversed(VERDICTS):
        found = F.when((score >= least_score) & (overlap >= least_overlap), name).otherwise(found)
    return found


def similarity_clusters(vectors: DataFrame, threshold: float, find: Callable[[DataFrame, float], DataFrame] = similar_links) -> DataFrame:
    """(cluster_id, article_id): DBSCAN with two members at least, where every point with a neighbour is a core point: the components of the pairs with
    cosine >= threshold, named by their smallest id. Others are noise and left out. find=approx_similar_pairs is for tables without clusters that are too large for all pairs of blocks; it may miss pairs."""
    found = components(find(vectors, threshold).select("a", "b"))
    return found.select(F.col("root").alias("cluster_id"), F.col("node").alias("article_id"))


def assemble(members: DataFrame, articles: DataFrame, status: str = "active") -> tuple[DataFrame, DataFrame]:
    """Clusters and members: the primary has the longest content (ties: smaller id), gives the name (100 characters) and the category; the tags are
    all members' tags in order, the date is the earliest."""
    own = articles.select(F.col("id").alias("article_id"), "headline", "content_length", "published_at", "category", "tags", "source_site")
    rows = members.join(own, "article_id")
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.transform(F.split("tags", ","), lambda x: F.trim(x)), lambda x: x != "")))))
    clusters = rows.groupBy("cluster_id").agg(
        F.min_by(F.struct("article_id", "headline", "category"), F.struct(-F.col("content_length"), "article_id")).alias("p"),
        F.count(F.lit(1)).alias("article_count"),
        F.to_date(F.min("published_at")).alias("event_date"),
        F.array_join(tags, ", ").alias("tags"),
    )
    clusters = clusters.select("cluster_id", truncated(F.col("p.headline"), 100).alias("cluster_name"), F.col("p.article_id").alias("primary_article_id"), "article_count", "event_date", F.coalesce(F.nullif(F.trim("p.category"), F.lit("")), F.lit("Unknown")).alias("category"), "tags", F.lit(status).alias("status"))
    joined = rows.join(clusters.select("cluster_id", "primary_article_id"), "cluster_id")
    return clusters, joined.select("cluster_id", "article_id", "content_length", "source_site", (F.col("article_id") == F.col("primary_article_id")).alias("is_primary"))


def with_similarity_to_primary(members: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").alias("article_id"), "v")
    primary = clusters.select("cluster_id", F.col("primary_article_id").alias("article_id")).join(v, "article_id").select("cluster_id", F.col("v").alias("pv"))
    return members.join(v, "article_id").join(primary, "cluster_id").withColumn("similarity_to_primary", F.round(cosine(F.col("v"), F.col("pv")), 4)).drop("v", "pv")


def coverage(clusters: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """How the sources of each active cluster with `least` members or more tell of it: rank by length, source, length, similarity to the primary, whether it is that."""
    wanted = clusters.filter((F.col("status") == "active") & (F.col("article_count") >= least)).select("cluster_id")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("content_length"), "article_id")
    return members.join(wanted, "cluster_id", "left_semi").withColumn("rank", F.row_number().over(order)).select("cluster_id", "rank", "article_id", "source_site", "content_length", "similarity_to_primary", "is_primary")


def refine(candidates: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Members (cluster_id, article_id) that stay. The one with the longest content (ties: the first) is in; then by position each candidate is compared to all members
    taken so far, and the nearest of them (cosine above 0, ties: the first) decides by cosine and by the headline words in common, as they are written.

    candidates: cluster_id, article_id (in one cluster), headline, content_length, position (whole numbers), v; those without v are left out. Of clusters left with one member none stays.
    """
    rows = candidates.filter("v IS NOT NULL")
    primary = rows.groupBy("cluster_id").agg(F.min_by("article_id", F.struct(-F.col("content_length"), "position")).alias("primary"))
    is_primary = F.col("article_id") == F.col("primary")
    place = F.when(is_primary, F.lit(-(1 << 62))).otherwise(F.col("position"))
    placed = rows.join(primary, "cluster_id").select(F.col("cluster_id").alias("group"), F.col("article_id").alias("id"), place.alias("place"), "v", word_set(F.col("headline")).alias("words"), is_primary.alias("forced"))

    def accept(score: float, overlap: float) -> bool:
        return accepted(score, overlap, threshold)

    taken = rows.select("cluster_id", "article_id").join(taken_greedily(placed, accept).withColumnRenamed("id", "article_id"), "article_id", "left_semi")
    whole = taken.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("cluster_id")
    return taken.join(whole, "cluster_id", "left_semi").select("cluster_id", "article_id")


def full_run(articles: DataFrame, vectors: DataFrame, as_of: datetime, hours: int, folder: str, threshold: float = 0.80, refine_threshold: float | None = None, model: str = "own") -> tuple[DataFrame, DataFrame]:
    """Clusters and members of the articles of the last hours, written over those of an earlier run in folder; a row about the run is added to folder/history.

    vectors: vec_id (an article's id), v, from embed_texts() or the caller's encoder. Articles without one take no part.
    """
    spark = articles.sparkSession
    window = recent_window(articles, as_of, hours)
    found = similarity_clusters(vectors.join(window.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), threshold)
    newest = -F.unix_micros(F.col("published_at").cast("timestamp"))
    own = window.select(F.col("id").alias("article_id"), "headline", "content_length", newest.alias("position"))
    members = refine(found.join(own, "article_id").join(vectors.select(F.col("vec_id").alias("article_id"), "v"), "article_id"), refine_threshold or threshold)
    clusters, listed = assemble(members, articles)
    for name, rows in (("clusters", clusters), ("members", listed)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    clusters, listed = (spark.read.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in (("clusters", clusters), ("members", listed)))
    run = clusters.agg(F.count(F.lit(1)).alias("clusters_created"), F.coalesce(F.sum("article_count"), F.lit(0)).alias("articles_clustered"))
    about = run.select(F.lit(as_of.isoformat(" ")).cast("timestamp_ntz").alias("run_date"), F.lit(hours).alias("time_window_hours"), F.lit(threshold).alias("similarity_threshold"), F.lit(model).alias("model_used"), F.lit("completed").alias("status"), "clusters_created", "articles_clustered")
    append_log(about, f"{folder}/history")
    return clusters, listed


def embed_texts(rows: DataFrame, text: str = "text", features: int = 256, encoder: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """rows with `embedding` and `text_hash`. By default hashed words weighted by inverse document frequency and brought to length 1; an encoder gets ENCODED_AT_ONCE
    texts at a time (null: empty) and gives their vectors."""
    hashed = rows.withColumn("text_hash", text_hash(F.coalesce(text, F.lit(""))))
    if encoder is not None:

        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                done: list = []
                for a in range(0, len(batch), ENCODED_AT_ONCE):
                    done += [[float(x) for x in v] for v in encoder(batch[a : a + ENCODED_AT_ONCE].tolist())]
                yield pd.Series(done, dtype=object)

        return hashed.withColumn("embedding", F.pandas_udf(encoded, "array<double>")(F.coalesce(text, F.lit("")))).select(*rows.columns, "embedding", "text_hash")
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = hashed.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features).transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="__idf", outputCol="__unit").transform(weighted)
    return unit.withColumn("embedding", vector_to_array("__unit")).select(*rows.columns, "embedding", "text_hash")


def to_embed(articles: DataFrame, stored: DataFrame, model: str, text: Column) -> DataFrame:
    """Articles without an embedding of the model, or whose text's hash is another than was embedded."""
    known = stored.filter(F.col("embedding_model") == model).select(F.col("article_id").alias("id"), "text_hash")
    fresh = articles.withColumn("new_hash", F.sha2(text, 256)).join(known, "id", "left")
    return fresh.filter(F.col("text_hash").isNull() | (F.col("text_hash") != F.col("new_hash"))).select("id", "new_hash", F.when(F.col("text_hash").isNull(), "new").otherwise("changed").alias("why"))
