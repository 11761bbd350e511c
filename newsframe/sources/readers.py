"""Sources: article tables, watermark maps, JSON collections, sitemaps, logs, asset inventories; and sinks that add to folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between cycles where nothing is configured.
DEFAULT_CYCLE = 600


def read_articles(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet, or any other format with the caller's options (format='jdbc', url=..., dbtable=...)."""
    form = options.pop("format", "parquet")
    return spark.read.format(form).options(**options).load(path) if path else spark.read.format(form).options(**options).load()


def watermark_rows(states: DataFrame, column: str = "state") -> DataFrame:
    """(scraper, category, ts) of JSON maps from category to 'YYYY-MM-DD HH:MM:SS'."""
    pairs = states.select("scraper", F.explode(F.from_json(column, "map<string,string>")).alias("category", "text"))
    return pairs.select("scraper", "category", F.try_to_timestamp("text", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"))


def cycle_seconds(config: Column, scraper: Column, default: int = DEFAULT_CYCLE, own_defaults: dict[str, int] | None = None) -> Column:
    """A scraper's own time, else the global one, from one JSON document; else the scraper's own default (none or 0: the general one)."""
    read = F.from_json(config, "global_cycle_time int, scrapers map<string,int>")
    known = {k: v for k, v in (own_defaults or {}).items() if v}
    own = [F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), scraper)] if known else []
    return F.coalesce(F.try_element_at(read["scrapers"], scraper), read["global_cycle_time"], *own, F.lit(default))


_URL = "loc string, lastmod string, _broken string"


def _newest(rows: DataFrame, cutoff: Column | None, cap: int) -> DataFrame:
    """(url, lastmod) of rows (loc, lastmod): addresses that end in a slug and a number, not before the cutoff; no or no valid lastmod is kept; the newest `cap`."""
    at = F.try_to_timestamp(F.regexp_replace(F.substring(F.trim("lastmod"), 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    kept = rows.select(F.trim("loc").alias("url"), at.alias("lastmod")).filter(F.col("url").rlike(r"/[^/]+/[0-9]+$"))
    if cutoff is not None:
        kept = kept.filter(F.col("lastmod").isNull() | (F.col("lastmod") >= cutoff))
    return kept.orderBy(F.desc_nulls_last("lastmod"), "url").limit(cap)


def sitemap_entries(documents: DataFrame, cutoff: Column | None = None, cap: int = 200) -> DataFrame:
    """The newest entries of sitemaps as texts (column xml), read as XML: entities, CDATA, comments and namespaces as they are meant. A text that is no XML gives none."""
    plain = F.regexp_replace("xml", r"(<\s*/?\s*)[A-Za-z_][\w.-]*:", "$1")  # names without the prefix of their namespace
    read = F.from_xml(plain, "url array<struct<loc: string, lastmod: string>>", {"mode": "PERMISSIVE"})
    return _newest(documents.select(F.explode(read["url"]).alias("u")).select("u.loc", "u.lastmod"), cutoff, cap)


def read_sitemaps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, broken) of sitemap files: loc and lastmod of each url element, and the text of what could not be read as one (with the loc that was, if any). A file is cut at its url elements, so a large one is many tasks."""
    rows = spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("ignoreNamespace", "true").schema(_URL).load(path)
    # both ask for loc as well: Spark doesn't read what is broken alone
    return rows.filter("_broken IS NULL AND loc IS NOT NULL").select("loc", "lastmod"), rows.filter("_broken IS NOT NULL AND coalesce(loc, '') <> '<'").select(F.col("_broken").alias("text"), "loc")


def newest_of_sitemaps(spark: SparkSession, path: str, cutoff: Column | None = None, cap: int = 200) -> DataFrame:
    return _newest(read_sitemaps(spark, path)[0], cutoff, cap)


def collection_stories(payloads: DataFrame, after_ms: int, column: str = "payload") -> DataFrame:
    """(slug, published_at) of collection items of type story that have both and are later than a time in milliseconds."""
    items = payloads.select(F.explode(F.from_json(column, "items array<struct<type: string, story: struct<slug: string, `published-at`: bigint>>>")["items"]).alias("i"))
    rows = items.filter("i.type = 'story'").select(F.col("i.story.slug").alias("slug"), F.col("i.story.published-at").alias("ms"))
    return rows.filter(F.col("slug").isNotNull() & (F.col("ms") > after_ms)).select("slug", F.timestamp_millis("ms").cast("timestamp_ntz").alias("published_at"))


def indexed_slugs(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(id, position, slug) of arrays whose values are positions in the array: the object at 0 names a list by key, its entries objects, their slug a string.
    Of equal slugs the first."""
    values = F.from_json(column, "array<string>")
    at = lambda a, i: F.get(a, i.cast("int"))
    listed = F.from_json(at(F.col("a"), F.get_json_object(F.col("a")[0], f"$.{key}")), "array<int>")
    slugs = F.transform(listed, lambda i: at(F.col("a"), F.get_json_object(at(F.col("a"), i), "$.slug")))
    return payloads.select("id", values.alias("a")).select("id", F.posexplode(F.array_distinct(slugs)).alias("position", "slug"))


def assets(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """(path, length) of the files with these extensions, whatever their case, in a folder and below it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
