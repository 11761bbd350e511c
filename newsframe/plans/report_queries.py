"""Queries of filters (P), reports (A) and ordered lists (O, W6) over the article views."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import reports as A
from ..operators.joins import keyword_matches
from .registry import query
from .table_queries import MATCHES
from .views import ARTICLES, CATEGORIES, KEYWORD_ROWS, RUNS, articles, as_of, categories, keywords, runs, table

#: A numeric category gives the section, else itself.
LABEL = """CASE WHEN regexp_full_match(trim(category), '[0-9]+') THEN coalesce(nullif(trim(section), ''), trim(category), 'Uncategorized')
  WHEN coalesce(trim(category), '') = '' THEN coalesce(nullif(trim(section), ''), 'Uncategorized') ELSE trim(category) END"""


@query("SELECT id, headline, source_site FROM articles WHERE lower(source_site) LIKE '%src1%'", ARTICLES)
def p1_source_contains(spark, sf_dir):
    return articles(spark, sf_dir).filter(P.contains(F.col("source_site"), "SRC1")).select("id", "headline", "source_site")


def _preset(name):
    def run(spark, sf_dir):
        rows = articles(spark, sf_dir)
        return rows.filter(P.on_days(F.col("published_at"), *P.report_days(name, as_of(rows)))).select("id", "published_at")

    run.__name__ = f"p2_report_{name}"
    return run


for _name, _days in (("today", "t::DATE AND t::DATE"), ("yesterday", "t::DATE - 1 AND t::DATE - 1"), ("week", "t::DATE - 6 AND t::DATE"), ("month", "t::DATE - 29 AND t::DATE")):
    query(f"SELECT id, published_at FROM articles, now_ WHERE published_at::DATE BETWEEN {_days}", ARTICLES)(_preset(_name))


def _listed(name):
    def run(spark, sf_dir):
        rows = articles(spark, sf_dir)
        return rows.filter(P.listed_within(F.col("published_at"), name, as_of(rows))).select("id", "published_at")

    run.__name__ = f"p3_listed_{name}"
    return run


for _name, _since in (("today", "published_at::DATE = t::DATE"), ("yesterday", "published_at::DATE = t::DATE - 1"), ("week", "published_at >= t - INTERVAL 7 DAYS"), ("month", "published_at >= t - INTERVAL 30 DAYS")):
    query(f"SELECT id, published_at FROM articles, now_ WHERE {_since}", ARTICLES)(_listed(_name))


@query("SELECT id, published_at FROM articles WHERE published_at::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'", ARTICLES)
def p4_custom_range(spark, sf_dir):
    rows = articles(spark, sf_dir)
    days = P.report_days("custom", as_of(rows), "2024-01-03", "2024-01-10")
    return rows.filter(P.on_days(F.col("published_at"), *days)).select("id", "published_at")


@query("SELECT id, category FROM articles WHERE category = ' en '", ARTICLES)
def p5_category(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.col("category") == " en ").select("id", "category")


@query("SELECT id, headline FROM articles WHERE lower(headline) LIKE '%pathetic%' OR lower(content) LIKE '%pathetic%'", ARTICLES)
def p6_search(spark, sf_dir):
    return P.search(articles(spark, sf_dir), text="pathetic").select("id", "headline")


@query("SELECT id, source_site, published_at FROM articles, now_ WHERE lower(source_site) LIKE '%src1%' AND published_at >= t - INTERVAL 30 DAYS AND category = ' en ' AND (lower(headline) LIKE '%the%' OR lower(content) LIKE '%the%') AND scraping_status = 'Success'", ARTICLES)
def p7_conjunction(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return P.search(rows, source="src1", preset="month", as_of=as_of(rows), category=" en ", text="the", status="Success").select("id", "source_site", "published_at")


@query("SELECT id, image_name FROM articles WHERE id IN (1, 5, 8, 13, 21, 34, 55, 89)", ARTICLES)
def p8_in_list(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.col("id").isin(1, 5, 8, 13, 21, 34, 55, 89)).select("id", "image_name")


@query("SELECT id, headline, published_at FROM articles WHERE lower(headline) LIKE '%the%of%' OR lower(headline) LIKE '%keit%' ORDER BY published_at DESC, id DESC LIMIT 10", ARTICLES)
def p9_wildcards_newest(spark, sf_dir):
    return P.like_newest(articles(spark, sf_dir), ["%the%of%", "%keit%"]).select("id", "headline", "published_at")


@query("SELECT id, published_at FROM articles, now_ WHERE published_at >= t - INTERVAL 48 HOURS AND content IS NOT NULL AND headline IS NOT NULL ORDER BY published_at DESC, id DESC LIMIT 50", ARTICLES)
def p10_recent_window(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return P.recent_window(rows, as_of(rows), 48, 50).select("id", "published_at")


@query(f"SELECT id, {LABEL} AS label FROM articles", ARTICLES)
def p11_category_label(spark, sf_dir):
    return articles(spark, sf_dir).select("id", P.category_label(F.col("category"), F.col("section")).alias("label"))


@query("SELECT id, CASE WHEN length(trim(headline)) < 3 OR trim(headline) = 'No headline' THEN 'headline' WHEN published_at IS NULL THEN 'date' WHEN length(trim(content)) < 50 THEN 'content' END AS reject_reason FROM articles", ARTICLES)
def p12_quality_gate(spark, sf_dir):
    reason = P.reject_reason(F.col("headline"), F.col("published_at"), F.col("content"), 50)
    return articles(spark, sf_dir).select("id", reason.alias("reject_reason"))


@query("SELECT id, CASE WHEN scraping_status = 'Success' THEN 'skip' WHEN processing_count >= 10 THEN 'exhausted' ELSE 'retry' END AS action FROM articles", ARTICLES)
def p13_retry(spark, sf_dir):
    return articles(spark, sf_dir).select("id", P.retry_action(F.col("scraping_status"), F.col("processing_count")).alias("action"))


#: Of the seven words that make an address no article image, each third page has one in it.
_ASSET = "CASE WHEN page_id % 3 = 0 THEN url || '/' || ['LOGO', 'icons', 'avatar', 'sprite', 'top-banner', 'ad-1', 'advertisement', 'default'][page_id % 8 + 1] || '.png' WHEN page_id % 7 = 1 THEN 'data:image/png;base64,AAAA' ELSE url END"


@query(f"SELECT page_id, asset FROM (SELECT page_id, {_ASSET} AS asset FROM pages) WHERE NOT starts_with(asset, 'data:') AND length(asset) >= 20 AND NOT (contains(lower(asset), 'logo') OR contains(lower(asset), 'icon') OR contains(lower(asset), 'avatar') OR contains(lower(asset), 'sprite') OR contains(lower(asset), 'banner') OR contains(lower(asset), 'ad-') OR contains(lower(asset), 'advertisement'))")
def p14_asset_url(spark, sf_dir):
    i = F.col("page_id")
    word = F.element_at(F.array(*(F.lit(w) for w in ("LOGO", "icons", "avatar", "sprite", "top-banner", "ad-1", "advertisement", "default"))), (i % 8 + 1).cast("int"))
    asset = F.when(i % 3 == 0, F.concat("url", F.lit("/"), word, F.lit(".png"))).when(i % 7 == 1, "data:image/png;base64,AAAA").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", asset.alias("asset")).filter(P.is_asset_url(F.col("asset")))


@query("SELECT id, keyword FROM keywords WHERE is_active = 1", KEYWORD_ROWS)
def p15_active_keywords(spark, sf_dir):
    return P.enabled(keywords(spark)).select("id", "keyword")


@query("SELECT keyword_id, article_id FROM matches WHERE article_id % 2 = 0", ARTICLES, KEYWORD_ROWS, MATCHES)
def p15_unread_matches(spark, sf_dir):
    found = keyword_matches(articles(spark, sf_dir), keywords(spark)).withColumn("is_read", (F.col("article_id") % 2).cast("int"))
    return P.unread(found).select("keyword_id", "article_id")


@query("SELECT id, site, is_active FROM categories WHERE is_active = 0 AND site = 'building'", CATEGORIES)
def p16_category_status(spark, sf_dir):
    return P.by_status(categories(spark, sf_dir), "disabled", "building").select("id", "site", "is_active")


@query("SELECT event_id, job, line FROM runs WHERE job = 's3' AND (lower(job) LIKE '%find%' OR lower(line) LIKE '%find%')", RUNS)
def p17_watermark_listing(spark, sf_dir):
    wanted = P.contains(F.col("job"), "FIND") | P.contains(F.col("line"), "FIND")
    return runs(spark, sf_dir).filter((F.col("job") == "s3") & wanted).select("event_id", "job", "line")


@query("SELECT id, section_label, category_url FROM categories WHERE lower(section_label) LIKE '%0007%' OR lower(category_url) LIKE '%/7/%' ORDER BY section_label", CATEGORIES)
def p18_category_search(spark, sf_dir):
    wanted = P.contains(F.col("section_label"), "0007") | P.contains(F.col("category_url"), "/7/")
    return categories(spark, sf_dir).filter(wanted).select("id", "section_label", "category_url").orderBy("section_label")


@query("SELECT id, source_url FROM articles, now_ WHERE make_date(regexp_extract(source_url, '/([0-9]{4})/([0-9]{2})/([0-9]{2})/', 1)::INT, regexp_extract(source_url, '/([0-9]{4})/([0-9]{2})/([0-9]{2})/', 2)::INT, regexp_extract(source_url, '/([0-9]{4})/([0-9]{2})/([0-9]{2})/', 3)::INT) >= t::DATE - 7", ARTICLES)
def p19_url_day(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.filter(P.url_day(F.col("source_url")) >= F.lit(as_of(rows).date() - timedelta(7))).select("id", "source_url")


@query("SELECT count(*) AS total, count(*) FILTER (published_at::DATE = t::DATE) AS today, count(*) FILTER (source_site LIKE '%src1%') AS n_src1, count(*) FILTER (source_site LIKE '%src2%') AS n_src2, count(*) FILTER (source_site LIKE '%src15%') AS n_src15 FROM articles, now_", ARTICLES)
def a1_dashboard(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return A.dashboard(rows, as_of(rows), ["src1", "src2", "src15"])


@query("SELECT source_site, count(*) AS n, floor(count(*) / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS percentage FROM articles GROUP BY source_site ORDER BY n DESC", ARTICLES)
def a2_report_by_source(spark, sf_dir):
    return A.by_source(articles(spark, sf_dir)).orderBy(F.desc("n"), "source_site")


@query("SELECT l_returnflag AS source_site, count(*) AS n, floor(count(*) / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS percentage FROM lineitem GROUP BY 1")
def a2_facts_by_source(spark, sf_dir):
    return A.by_source(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source_site")))


@query("SELECT published_at::DATE AS day, count(*) AS n FROM articles GROUP BY 1 ORDER BY 1", ARTICLES)
def a3_by_day(spark, sf_dir):
    return A.by_day(articles(spark, sf_dir)).orderBy("day")


@query("SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1")
def a3_orders_by_day(spark, sf_dir):
    return A.by_day(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"SELECT source_site, {LABEL} AS label, count(*) AS n FROM articles GROUP BY source_site, section, category", ARTICLES)
def a4_by_source_category(spark, sf_dir):
    return A.by_source_category(articles(spark, sf_dir))


@query(f"SELECT source_site, {LABEL} AS label, count(*) AS n FROM articles GROUP BY ALL", ARTICLES)
def a4_by_source_label(spark, sf_dir):
    return A.by_source_category(articles(spark, sf_dir), merge_labels=True)


@query("""SELECT sum(n)::BIGINT AS total, count(*) AS active_sources, 30::BIGINT AS days, floor(sum(n) / 30 + 0.5)::BIGINT AS per_day, arg_min(source_site, (-n, source_site)) AS top_source
  FROM (SELECT source_site, count(*) AS n FROM articles, now_ WHERE published_at::DATE BETWEEN t::DATE - 29 AND t::DATE GROUP BY 1)""", ARTICLES)
def a5_summary(spark, sf_dir):
    rows = articles(spark, sf_dir)
    first, last = P.report_days("month", as_of(rows))
    return A.summary(rows.filter(P.on_days(F.col("published_at"), first, last)), first, last)


@query("SELECT site, count(*) AS total, sum(is_active)::BIGINT AS active, sum(1 - is_active)::BIGINT AS disabled FROM categories GROUP BY ROLLUP (site)", CATEGORIES)
def a6_category_totals(spark, sf_dir):
    return A.category_totals(categories(spark, sf_dir))


@query("SELECT max(id) AS max_id, greatest(0, max(id) - 100)::BIGINT AS pending FROM articles", ARTICLES)
def a7_backlog(spark, sf_dir):
    return A.backlog(articles(spark, sf_dir), 100)


@query("SELECT site AS category, count(*) AS n FROM categories GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5", CATEGORIES)
def a11_top_categories(spark, sf_dir):
    return A.top_groups(categories(spark, sf_dir).withColumnRenamed("site", "category"), "category", 5)


@query("SELECT ts::DATE AS day, count(*) AS n FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL 7 DAYS GROUP BY 1", RUNS)
def a12_recent_days(spark, sf_dir):
    rows = runs(spark, sf_dir)
    last = rows.agg(F.max("ts")).first()[0]
    return A.by_day(rows.filter(F.col("ts") >= F.lit((last - timedelta(days=7)).isoformat(" ")).cast("timestamp_ntz")), "ts")


@query("SELECT count(*) AS n FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL 24 HOURS", RUNS)
def a12_last_day(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return A.created_since(rows, "ts", rows.agg(F.max("ts")).first()[0] - timedelta(hours=24))


@query("SELECT event_id, job, ts, outcome FROM runs ORDER BY ts DESC, event_id DESC LIMIT 1", RUNS)
def a13_latest_run(spark, sf_dir):
    top = F.max_by(F.struct("event_id", "job", "ts", "outcome"), F.struct("ts", "event_id")).alias("r")
    return runs(spark, sf_dir).agg(top).select("r.*")


@query("SELECT job, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS latest FROM runs GROUP BY 1", RUNS)
def a14_latest_text(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("job").agg(F.max(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("latest"))


@query("""SELECT count(*) AS total, count(*) FILTER (outcome = 'ok') AS running, count(*) FILTER (outcome = 'error') AS stopped, sum(errors)::BIGINT AS errors
  FROM (SELECT job, arg_max(outcome, (ts, event_id)) AS outcome, count(*) FILTER (outcome = 'error') AS errors FROM runs GROUP BY job)""", RUNS)
def a15_fleet(spark, sf_dir):
    last = F.max_by("outcome", F.struct("ts", "event_id"))
    jobs = runs(spark, sf_dir).groupBy("job").agg(last.alias("outcome"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "ok").alias("running"), F.count_if(F.col("outcome") == "error").alias("stopped"), F.sum("errors").alias("errors"))


@query("""SELECT site, prefix, count(*) AS total, sum(is_active)::BIGINT AS active, CASE WHEN sum(is_active) = 0 THEN 'disabled' WHEN sum(is_active) = count(*) THEN 'active' ELSE 'partially-active' END AS state
  FROM (SELECT site, is_active, array_to_string(p[1:i], '/') AS prefix FROM (SELECT site, is_active, p, unnest(range(1, len(p) + 1)) AS i FROM
    (SELECT site, is_active, list_filter(string_split(regexp_extract(category_url, '^https?://[^/]+(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS p FROM categories))) GROUP BY ALL""", CATEGORIES)
def a16_path_rollup(spark, sf_dir):
    return A.path_rollup(categories(spark, sf_dir))


@query("""SELECT sum(floor(86400 / coalesce(s, 600)))::BIGINT AS cycles_per_day, floor(avg(coalesce(s, 600)))::BIGINT AS mean_seconds, count(s) AS overrides
  FROM (SELECT job, CASE WHEN count(*) % 2 = 0 THEN 60 + count(*) % 240 END AS s FROM runs GROUP BY job)""", RUNS)
def a17_cycle_budget(spark, sf_dir):
    n = F.count(F.lit(1))
    return A.cycle_budget(runs(spark, sf_dir).groupBy("job").agg(F.when(n % 2 == 0, 60 + n % 240).alias("seconds")))


@query("SELECT DISTINCT site FROM categories ORDER BY 1", CATEGORIES)
def a24_labels(spark, sf_dir):
    return categories(spark, sf_dir).select("site").distinct().orderBy("site")


@query("""SELECT job, count(*) AS total, count(*) FILTER (ts::DATE = l::DATE) AS today, count(*) FILTER (outcome = 'error' AND ts > l - INTERVAL 24 HOURS) AS errors_24h, max(ts) AS last_run,
    count(*) FILTER (outcome = 'error' AND (g IS NULL OR (ts, event_id) > g)) AS consecutive_errors
  FROM runs JOIN (SELECT job, max((ts, event_id)) FILTER (outcome <> 'error') AS g FROM runs GROUP BY job) USING (job), (SELECT max(ts) AS l FROM runs) GROUP BY job""", RUNS)
def a25_source_health(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return A.source_health(rows, rows.agg(F.max("ts")).first()[0])


@query("SELECT section, count(*) FILTER (scraping_status = 'Success') AS n_Success, count(*) FILTER (scraping_status = 'Failed') AS n_Failed FROM articles GROUP BY 1", ARTICLES)
def a26_outcomes(spark, sf_dir):
    return A.outcome_counts(articles(spark, sf_dir), "section", "scraping_status", ["Success", "Failed"])


@query("""SELECT s AS source_site, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS has_data FROM (SELECT 'src' || range AS s FROM range(0, 25)) LEFT JOIN (SELECT source_site, count(*) AS n FROM articles GROUP BY 1) ON s = source_site""", ARTICLES)
def j14_complete_report(spark, sf_dir):
    sources = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_site"))
    counts = articles(spark, sf_dir).groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    return A.complete_report(counts, sources).orderBy(F.desc("has_data"), F.desc("n"), "source_site")


@query(f"SELECT source_site, label, n, round(n / max(n) OVER (PARTITION BY source_site) * 100, 6) AS bar FROM (SELECT source_site, {LABEL} AS label, count(*) AS n FROM articles GROUP BY ALL)", ARTICLES)
def w6_bars(spark, sf_dir):
    return A.bar_percentages(A.by_source_category(articles(spark, sf_dir), merge_labels=True))
