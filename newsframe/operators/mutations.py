"""Changes of tables as functions from DataFrame to DataFrame; a v2 table may take them by mergeInto."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows in place of those of target with their keys, and added where there are none. rows has distinct keys."""
    return target.join(rows.select(key), key, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """target and those of rows whose keys it hasn't yet, the first by order of each."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti").select(target.columns))


def patch(target: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of target set to a patch's value where its column has_<field> holds; the value may be null."""
    given = patches.select(key, *(F.struct(F.col(f"has_{f}").alias("has"), F.col(f).alias("value")).alias(f"__{f}") for f in fields))
    joined = target.join(given, key, "left")
    return joined.select(*(F.when(F.col(f"__{c}.has"), F.col(f"__{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns))


def delete(target: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return target.join(keys, on, "left_anti")


def toggle(target: DataFrame, chosen: Column, to: int | None = None) -> DataFrame:
    """is_active of the chosen rows set, or turned round where no value is given."""
    return target.withColumn("is_active", F.when(chosen, F.lit(to) if to is not None else 1 - F.col("is_active")).otherwise(F.col("is_active")))


def insert_rejecting(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be added and those rejected for keys that exist."""
    return rows.join(target.select(*keys), list(keys), "left_anti"), rows.join(target.select(*keys), list(keys), "left_semi")


def record_failures(target: DataFrame, failures: DataFrame) -> DataFrame:
    """(source_url, headline, scraping_status, processing_count, tags): one attempt more with the error, or a row that only tells of the failure."""
    own = target.select("source_url", "headline", "scraping_status", "processing_count", "tags", F.lit(True).alias("known"))
    both = own.join(failures.select("source_url", "error"), "source_url", "full")
    failed = F.col("error").isNotNull()
    return both.select(
        "source_url",
        F.coalesce("headline", F.lit("Failed to scrape")).alias("headline"),
        F.when(failed, "Failed").otherwise(F.col("scraping_status")).alias("scraping_status"),
        (F.coalesce("processing_count", F.lit(0)) + failed.cast("long")).alias("processing_count"),
        F.when(failed, F.concat(F.lit("Error: "), "error")).otherwise(F.col("tags")).alias("tags"),
    )


def record_successes(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """Headline and content of rows that were read again, one attempt more, status Success."""
    new = fresh.select("id", F.col("headline").alias("__h"), F.col("content").alias("__c"))
    got = F.col("__c").isNotNull()
    joined = target.join(new, "id", "left")
    return joined.select(
        "id",
        F.when(got, F.col("__h")).otherwise(F.col("headline")).alias("headline"),
        F.when(got, F.col("__c")).otherwise(F.col("content")).alias("content"),
        F.when(got, "Success").otherwise(F.col("scraping_status")).alias("scraping_status"),
        (F.col("processing_count") + got.cast("long")).alias("processing_count"),
    )


def apply_recheck(target: DataFrame, changes: DataFrame, when: Column, overwrite_empty: bool = False) -> DataFrame:
    """target (id, headline, content, updates) after a recheck: changed texts, when they changed and how often. An empty new text leaves the old one,
    unless overwrite_empty."""
    new = changes.select("id", "new_headline", "new_content")
    pick = lambda new, old: F.coalesce(F.col(new) if overwrite_empty else F.nullif(F.col(new), F.lit("")), F.col(old))
    hit = F.col("new_content").isNotNull()
    joined = target.join(new, "id", "left")
    return joined.select("id", F.when(hit, pick("new_headline", "headline")).otherwise(F.col("headline")).alias("headline"), F.when(hit, pick("new_content", "content")).otherwise(F.col("content")).alias("content"), F.when(hit, when).alias("updated_at"), (F.coalesce("updates", F.lit(0)) + hit.cast("int")).alias("updates"))


def fan_out(rows: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """Rows whose key the located table has not yet."""
    return rows.join(located.select(key), key, "left_anti")


def merge_clusters(clusters: DataFrame, members: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    """The smaller of two clusters goes into the larger (ties: into a): members without repeats, status merged, counts anew."""
    sizes = members.filter(F.col("cluster_id").isin(a, b)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    target = sizes.agg(F.min_by("cluster_id", F.struct(-F.col("n"), (F.col("cluster_id") != a))).alias("target"))
    both = F.col("cluster_id").isin(a, b)
    named = members.join(F.broadcast(target), F.lit(True))
    moved = named.withColumn("cluster_id", F.when(both, F.col("target")).otherwise(F.col("cluster_id"))).drop("target").dropDuplicates(["cluster_id", "article_id"])
    counts = moved.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("__n"))
    new = clusters.join(F.broadcast(target), F.lit(True)).join(counts, "cluster_id", "left")
    status = F.when(both & (F.col("cluster_id") != F.col("target")), "merged").otherwise(F.col("status"))
    return new.select(*(status.alias(c) if c == "status" else F.coalesce("__n", F.lit(0)).alias(c) if c == "article_count" else F.col(c) for c in clusters.columns)), moved


def archive(clusters: DataFrame, chosen: Column) -> DataFrame:
    return clusters.withColumn("status", F.when(chosen, "archived").otherwise(F.col("status")))


def remove_members(members: DataFrame, chosen: Column) -> DataFrame:
    """Members without the chosen ones; a primary one stays."""
    return members.filter(~chosen | F.col("is_primary"))


def change_primary(clusters: DataFrame, members: DataFrame, cluster_id: int, article_id: int) -> tuple[DataFrame, DataFrame]:
    """A member made primary; nothing changes if it is none."""
    found = members.filter((F.col("cluster_id") == cluster_id) & (F.col("article_id") == article_id)).select("cluster_id", F.lit(article_id).cast("long").alias("__new"))
    new_members = members.join(F.broadcast(found.limit(1)), "cluster_id", "left").withColumn("is_primary", F.when(F.col("__new").isNotNull(), F.col("article_id") == F.col("__new")).otherwise(F.col("is_primary"))).select(members.columns)
    new_clusters = clusters.join(F.broadcast(found.limit(1)), "cluster_id", "left").withColumn("primary_article_id", F.coalesce("__new", "primary_article_id")).select(clusters.columns)
    return new_clusters, new_members


def upsert_labels(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels by name whatever its case: later rows replace stored ones."""
    keyed = rows.withColumn("__k", F.lower("label"))
    kept = target.withColumn("__k", F.lower("label")).join(keyed.select("__k"), "__k", "left_anti")
    return kept.select(target.columns).unionByName(rows.select(target.columns))
