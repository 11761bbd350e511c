"""Aggregations for reports: each one pass over its rows, with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import category_label, contains, on_days


def half_up(value: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(value + 0.5)


def dashboard(rows: DataFrame, as_of: datetime, sources: Sequence[str]) -> DataFrame:
    """Total, today's, and for each source name the rows whose source contains it; names may overlap."""
    day = as_of.date()
    counts = [F.count_if(contains(F.col("source_site"), s)).alias(f"n_{s}") for s in sources]
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(on_days(F.col("published_at"), day, day)).alias("today"), *counts)


def by_source(rows: DataFrame) -> DataFrame:
    """Count and percentage with one decimal."""
    counts = rows.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row, so that no window gathers all groups
    return counts.crossJoin(F.broadcast(total)).select("source_site", "n", (half_up(F.col("n") / F.col("total") * 1000) / 10).alias("percentage"))


def by_day(rows: DataFrame, column: str = "published_at") -> DataFrame:
    return rows.groupBy(F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def created_since(rows: DataFrame, column: str, since: datetime) -> DataFrame:
    """How many rows are not older than a time."""
    return rows.filter(F.col(column) >= F.lit(since.isoformat(" ")).cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"))


def matches_by_source(matches: DataFrame, articles: DataFrame) -> DataFrame:
    """How many matches the articles of each source have."""
    own = articles.select(F.col("id").alias("article_id"), "source_site")
    return matches.join(own, "article_id").groupBy("source_site").agg(F.count(F.lit(1)).alias("match_count"))


def by_source_category(rows: DataFrame, merge_labels: bool = False) -> DataFrame:
    """Counts by source and category label. The raw columns are what is grouped by, so that a label can come twice, unless merge_labels."""
    label = category_label(F.col("category"), F.col("section"))
    if merge_labels:
        return rows.groupBy("source_site", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("source_site", "section", "category").agg(F.count(F.lit(1)).alias("n")).select("source_site", label.alias("label"), "n")


def summary(rows: DataFrame, first_day, last_day) -> DataFrame:
    """Total, active sources, inclusive days, average a day, and the source with most rows (ties: first by name)."""
    counts = rows.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    days = (last_day - first_day).days + 1
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.alias("total"), F.count(F.lit(1)).alias("active_sources"), F.lit(days).cast("long").alias("days"), half_up(total / days).alias("per_day"), F.min_by("source_site", F.struct(-F.col("n"), "source_site")).alias("top_source"))


def category_totals(rows: DataFrame) -> DataFrame:
    """Categories, active and disabled ones by site, and over all sites (site null)."""
    active = F.sum(F.col("is_active").cast("long"))
    return rows.rollup("site").agg(F.count(F.lit(1)).alias("total"), active.alias("active"), (F.count(F.lit(1)) - active).alias("disabled"))


def backlog(rows: DataFrame, offset: int) -> DataFrame:
    """Largest id and how many ids are past the offset."""
    top = F.coalesce(F.max("id"), F.lit(0))
    return rows.agg(top.alias("max_id"), F.greatest(F.lit(0).cast("long"), top - offset).alias("pending"))


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    """Groups, and average, least and largest size."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("n"), 6).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def top_groups(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def path_rollup(categories: DataFrame, marker: str | None = None) -> DataFrame:
    """For every prefix of the path of an address: categories, active ones and whether all, some or none are active."""
    path = F.filter(F.split(F.regexp_extract("category_url", "^https?://[^/]+(/[^?#]*)?", 1), "/"), lambda x: x != "")
    # depths of a fixed form explode row by row; the aggregation combines them before the shuffle
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", 1, i), "/"))
    rows = categories.select("site", "is_active", path.alias("path")).filter(F.size("path") > 0).select("site", "is_active", F.explode(prefixes).alias("prefix"))
    active = F.sum(F.col("is_active").cast("long"))
    state = F.when(F.col("active") == 0, "disabled").when(F.col("active") == F.col("total"), "active").otherwise("partially-active")
    return rows.groupBy("site", "prefix").agg(F.count(F.lit(1)).alias("total"), active.alias("active")).withColumn("state", state)


def cycle_budget(jobs: DataFrame, default: int = 600) -> DataFrame:
    """Cycles a day of all jobs, the mean cycle time and the jobs with a time of their own (column seconds, null: the default)."""
    t = F.coalesce("seconds", F.lit(default))
    return jobs.agg(F.sum(F.floor(F.lit(86400) / t)).alias("cycles_per_day"), F.floor(F.avg(t)).alias("mean_seconds"), F.count("seconds").alias("overrides"))


def source_health(runs: DataFrame, as_of: datetime) -> DataFrame:
    """By job: runs, today's, errors of the last 24 hours, last run, and errors since the last good run."""
    since = F.lit(as_of.isoformat(" ")).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    day = as_of.date()
    bad = F.col("outcome") == "error"
    good = runs.groupBy("job").agg(F.max(F.when(~bad, F.struct("ts", "event_id"))).alias("good"))
    joined = runs.join(good, "job")
    after = F.col("good").isNull() | (F.struct("ts", "event_id") > F.col("good"))
    return joined.groupBy("job").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(on_days(F.col("ts"), day, day)).alias("today"),
        F.count_if(bad & (F.col("ts") > since)).alias("errors_24h"),
        F.max("ts").alias("last_run"),
        F.count_if(bad & after).alias("consecutive_errors"),
    )


def outcome_counts(rows: DataFrame, group: str, outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """A column for each outcome."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes))


def complete_report(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """Every listed source with its count, 0 if it has none; those with data first."""
    n = F.coalesce("n", F.lit(0))
    joined = sources.join(counts, "source_site", "left").select("source_site", n.alias("n"))
    return joined.withColumn("has_data", F.col("n") > 0)


def bar_percentages(rows: DataFrame) -> DataFrame:
    """n as a share of the largest n of its source."""
    top = F.max("n").over(Window.partitionBy("source_site"))
    return rows.withColumn("bar", F.round(F.col("n") / top * 100, 6))
