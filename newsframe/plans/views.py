"""Article-shaped views of the supplied tables, in Spark and as DuckDB common table expressions (see FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import importable

#: Lines of jobs on articles: inserted, updated, updated with success told beside it, none of them as it lacks the mark, failed.
PURCHASE_LINES = ("✓ Inserted new article", "[OK] Updated existing article 5", "✓ SUCCESS: Updated existing article (id 5)", "Inserted new article", "✗ Failed to scrape")

KEYWORDS = ((1, "the ", 1), (2, "tion ", 1), (3, "anbleing", 1), (4, "keit", 1), (5, "ción", 1), (6, "eaux", 1), (7, "worthless", 1), (8, "pathetic", 0), (9, "license", 1), (10, "token", 0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; every column comes from one row, so that filters and pruning reach the scan."""
    d = F.col("doc_id")
    published = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(doc_id) * 37)")
    category = F.when(d % 4 == 0, (d % 7).cast("string")).when(d % 4 == 1, "").when(d % 4 == 2, F.concat(F.lit(" "), "lang", F.lit(" ")))
    headline = F.substring(F.split("text", "\n", 2)[0], 1, 120)
    return (
        table(spark, sf_dir, "documents")
        .withColumn("published_at", published)
        .select(
            d.alias("id"),
            headline.alias("headline"),
            headline.alias("actual_headline"),
            F.col("text").alias("content"),
            F.length("text").cast("long").alias("content_length"),
            "published_at",
            F.col("source").alias("source_site"),
            F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("sec-"), (d % 5).cast("string"))).alias("section"),
            category.alias("category"),
            F.array_join(F.slice(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != ""), 1, 3), ", ").alias("tags"),
            F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.date_format("published_at", "yyyy/MM/dd"), F.lit("/"), d.cast("string")).alias("source_url"),
            F.concat(F.lit("img_"), (d % 600).cast("string"), F.lit(".jpg")).alias("image_name"),
            F.when(d % 11 == 0, "Failed").otherwise("Success").alias("scraping_status"),
            (d % 13).alias("processing_count"),
        )
    )


def as_of(rows: DataFrame) -> datetime:
    """The latest publication: relative filters never ask the clock."""
    return rows.agg(F.max("published_at")).first()[0]


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.lower("c_mktsegment")
    url = F.concat(F.lit("https://"), site, F.lit(".example/country-news/"), (F.col("c_nationkey") % 8).cast("string"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("/"), (F.col("c_custkey") % 50).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), site.alias("site"), F.col("c_name").alias("section_label"), url.alias("category_url"), (F.col("c_acctbal") > 0).cast("int").alias("is_active"))


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEYWORDS), "id long, keyword string, is_active int")


def rechecked(rows: DataFrame) -> DataFrame:
    """A second reading of every article: some with doubled blanks, some longer, some empty."""
    i = F.col("id")
    content = F.when(i % 10 == 0, F.replace("content", F.lit(" "), F.lit("  "))).when(i % 10 == 1, F.concat("content", F.lit(" updated"))).when(i % 10 == 2, "").otherwise(F.col("content"))
    return rows.select("id", "headline", content.alias("content"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_runs(table(spark, sf_dir, "events"))


def as_runs(events: DataFrame) -> DataFrame:
    """events as a log of jobs."""
    e = F.col("event_type")
    line = F.when(e == "view", F.concat(F.lit("[STATUS:finding:"), F.col("user_id").cast("string"), F.lit("]"))).when(e == "click", F.concat(F.lit("[STATUS:extracting:"), F.col("event_id").cast("string"), F.lit("]"))).when(e == "purchase", F.element_at(F.array(*(F.lit(x) for x in PURCHASE_LINES)), (F.col("event_id") % len(PURCHASE_LINES) + 1).cast("int"))).when(e == "error", "Error: failed").otherwise("PROGRESS 3 10")
    return events.select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 16).cast("string")).alias("job"), "ts", F.when(e == "error", "error").otherwise("ok").alias("outcome"), line.alias("line"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 120).alias("asset_id"), F.col("embedding").cast("array<double>").alias("v"), "label", (0.5 + (F.col("vec_id") % 5) / 10).alias("confidence"))


# The same views for DuckDB.

ARTICLES = """articles AS (SELECT doc_id AS id, left(split_part(text, chr(10), 1), 120) AS headline, left(split_part(text, chr(10), 1), 120) AS actual_headline,
  text AS content, length(text)::BIGINT AS content_length, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37)::BIGINT) AS published_at, source AS source_site,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'sec-' || (doc_id % 5) END AS section,
  CASE doc_id % 4 WHEN 0 THEN (doc_id % 7)::VARCHAR WHEN 1 THEN '' WHEN 2 THEN ' ' || lang || ' ' END AS category,
  array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')[1:3], ', ') AS tags,
  'https://' || source || '.example/' || lang || '/' || strftime(TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37)::BIGINT), '%Y/%m/%d') || '/' || doc_id AS source_url,
  'img_' || (doc_id % 600) || '.jpg' AS image_name, CASE WHEN doc_id % 11 = 0 THEN 'Failed' ELSE 'Success' END AS scraping_status, doc_id % 13 AS processing_count
  FROM documents), now_ AS (SELECT max(published_at) AS t FROM articles)"""

CATEGORIES = """categories AS (SELECT c_custkey AS id, lower(c_mktsegment) AS site, c_name AS section_label,
  'https://' || lower(c_mktsegment) || '.example/country-news/' || (c_nationkey % 8) || '/' || c_nationkey || '/' || (c_custkey % 50) AS category_url, (c_acctbal > 0)::INTEGER AS is_active FROM customer)"""

KEYWORD_ROWS = "keywords AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {a})" for i, k, a in KEYWORDS) + ") AS k(id, keyword, is_active))"

RECHECKED = """rechecked AS (SELECT id, headline, CASE id % 10 WHEN 0 THEN replace(content, ' ', '  ') WHEN 1 THEN content || ' updated' WHEN 2 THEN '' ELSE content END AS content FROM articles)"""

RUNS = f"""runs AS (SELECT event_id, 's' || (user_id % 16) AS job, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome,
  CASE event_type WHEN 'view' THEN '[STATUS:finding:' || user_id || ']' WHEN 'click' THEN '[STATUS:extracting:' || event_id || ']' WHEN 'purchase' THEN {list(PURCHASE_LINES)}[event_id % {len(PURCHASE_LINES)} + 1] WHEN 'error' THEN 'Error: failed' ELSE 'PROGRESS 3 10' END AS line, value FROM events)"""

VECTORS = "vectors AS (SELECT vec_id, vec_id % 120 AS asset_id, embedding::DOUBLE[] AS v, label, 0.5::DOUBLE + (vec_id % 5) / 10.0::DOUBLE AS confidence FROM embeddings)"


def clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters and members: components of vectors with cosine 0.40 and above; vec_id stands for an article's id."""
    from ..operators.clustering import assemble, similarity_clusters

    return assemble(similarity_clusters(vectors(spark, sf_dir), 0.40), articles(spark, sf_dir))


CLUSTERS = f"""{ARTICLES}, {VECTORS},
  pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS score FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.4),
  ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
  comps AS (SELECT a AS article_id, min(b) AS cluster_id FROM reach GROUP BY a),
  members AS (SELECT cluster_id, article_id, content_length, source_site, row_number() OVER (PARTITION BY cluster_id ORDER BY content_length DESC, article_id) = 1 AS is_primary FROM comps JOIN articles ON id = article_id),
  event_clusters AS (SELECT m.cluster_id, CASE WHEN length(p.headline) > 100 THEN left(p.headline, 100) || '...' ELSE p.headline END AS cluster_name, p.id AS primary_article_id, m.article_count, m.event_date,
    coalesce(nullif(trim(p.category), ''), 'Unknown') AS category, m.tags, 'active' AS status
    FROM (SELECT cluster_id, count(*) AS article_count, min(published_at)::DATE AS event_date, arg_min(article_id, (-c.content_length, article_id)) AS primary_id,
      array_to_string(list_sort(list_distinct(flatten(list(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''))))), ', ') AS tags
      FROM comps JOIN articles c ON id = article_id GROUP BY cluster_id) m JOIN articles p ON p.id = m.primary_id)"""
