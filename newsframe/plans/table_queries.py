"""Queries of joins (J), windows (W), ordered lists (O), set operations (U), mutations (M) and sinks (S10, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine, hamming, norm
from ..operators import joins as J
from ..operators import mutations as M
from ..operators import similarity as S
from ..operators import windows as W
from .registry import query
from .views import ARTICLES, CATEGORIES, CLUSTERS, KEYWORD_ROWS, RECHECKED, RUNS, VECTORS, articles, categories, clusters, keywords, rechecked, runs, table, vectors

MATCHES = "matches AS (SELECT k.id AS keyword_id, a.id AS article_id FROM articles a JOIN keywords k ON is_active = 1 AND contains(lower(headline || ' ' || content), lower(keyword)))"


def _matches(spark, sf_dir):
    return J.keyword_matches(articles(spark, sf_dir), keywords(spark))


@query("SELECT c.cluster_id, cluster_name, headline, content_length FROM event_clusters c LEFT JOIN articles ON id = primary_article_id", CLUSTERS)
def j1_cluster_primary(spark, sf_dir):
    own = articles(spark, sf_dir).select(F.col("id").alias("primary_article_id"), "headline", "content_length")
    return clusters(spark, sf_dir)[0].join(own, "primary_article_id", "left").select("cluster_id", "cluster_name", "headline", "content_length")


@query("SELECT article_id, keyword_id, keyword, source_site, (SELECT count(*) FROM matches) AS total, ceil((SELECT count(*) FROM matches) / 20)::BIGINT AS pages FROM matches JOIN keywords k ON k.id = keyword_id JOIN articles a ON a.id = article_id ORDER BY published_at DESC, article_id DESC, keyword_id LIMIT 20 OFFSET 20", ARTICLES, KEYWORD_ROWS, MATCHES)
def j2_match_page(spark, sf_dir):
    rows = J.match_listing(_matches(spark, sf_dir), keywords(spark), articles(spark, sf_dir)).select("article_id", "keyword_id", "keyword", "source_site", "published_at")
    return W.page(rows, 2, 20, F.desc("published_at"), F.desc("article_id"), F.asc("keyword_id")).drop("published_at")


@query("SELECT article_id, cluster_id, cluster_name FROM members JOIN event_clusters USING (cluster_id) WHERE status = 'active'", CLUSTERS)
def j3_active_members(spark, sf_dir):
    c, m = clusters(spark, sf_dir)
    return m.join(c.filter("status = 'active'"), "cluster_id").select("article_id", "cluster_id", "cluster_name")


@query("SELECT id FROM articles ANTI JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) ON id = vec_id", ARTICLES)
def j4_without_embedding(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.when(F.col("vec_id") % 3 == 0, "small").otherwise("other").alias("embedding_model"))
    return J.without_embedding(articles(spark, sf_dir), stored, "small").select("id")


@query("SELECT count(*) FILTER (id % 4 <> 0) AS n_new, count(*) FILTER (id % 4 = 0) AS n_known FROM articles", ARTICLES)
def j5_known_urls(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", "source_url")
    return J.known_counts(rows, rows.filter("id % 4 = 0"), "source_url")


@query("SELECT vec_id, arg_max(headline, id) AS headline, max(id) AS id FROM vectors LEFT JOIN articles ON image_name = 'img_' || asset_id || '.jpg' GROUP BY vec_id", ARTICLES, VECTORS)
def j6_enrich(spark, sf_dir):
    named = vectors(spark, sf_dir).select("vec_id", F.concat(F.lit("img_"), F.col("asset_id").cast("string"), F.lit(".jpg")).alias("image_name"))
    return J.enrich_last(named, articles(spark, sf_dir), "image_name", "id", ["headline", "id"]).drop("image_name")


@query("SELECT * FROM matches", ARTICLES, KEYWORD_ROWS, MATCHES)
def j7_keyword_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("SELECT keyword, id AS article_id FROM articles JOIN (SELECT DISTINCT unnest(string_split_regex(lower(text), '\\s+')) AS keyword FROM benchmark) ON keyword <> '' AND contains(lower(headline || ' ' || content), keyword)", ARTICLES)
def j7_many_keywords(spark, sf_dir):
    """Every word of the benchmark as a keyword, joined to the articles."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "\\s+")).alias("keyword")).filter("keyword <> ''").distinct()
    text = articles(spark, sf_dir).select(F.col("id").alias("article_id"), F.lower(F.concat_ws(" ", "headline", "content")).alias("text"))
    return J.gram_matches(text, words.select(F.col("keyword").alias("keyword_id"), "keyword")).select(F.col("keyword_id").alias("keyword"), "article_id")


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.35", VECTORS)
def j8_similar_pairs(spark, sf_dir):
    return S.similar_pairs(vectors(spark, sf_dir), 0.35).withColumn("score", F.round("score", 6))


_NEAR = "copies AS (SELECT vec_id, v FROM vectors UNION ALL SELECT vec_id + 1000000, list_concat([v[1] + 0.1 + (vec_id % 7) / 20.0::DOUBLE], v[2:]) FROM vectors)"


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM copies x JOIN copies y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93", VECTORS, _NEAR)
def j8_near_copies(spark, sf_dir):
    """Vectors beside copies with a changed component: pairs at a high threshold, in small cells, most of which need not meet."""
    v = vectors(spark, sf_dir).select("vec_id", "v")
    changed = F.concat(F.array(F.get("v", F.lit(0)) + 0.1 + (F.col("vec_id") % 7) / 20), F.slice("v", 2, 1 << 20))
    copies = v.unionByName(v.select((F.col("vec_id") + 1_000_000).alias("vec_id"), changed.alias("v")))
    return S.similar_pairs(copies, 0.93, block=64).withColumn("score", F.round("score", 6))


@query("SELECT id, section, coalesce(CASE section WHEN 'sec-1' THEN 11 WHEN 'sec-2' THEN 12 WHEN 'sec-3' THEN 13 END, 7) AS category_id FROM articles", ARTICLES)
def j9_category_ids(spark, sf_dir):
    mapping = spark.createDataFrame([("sec-1", 11), ("sec-2", 12), ("sec-3", 13)], "section string, category_id int")
    return J.lookup_id(articles(spark, sf_dir).select("id", "section"), F.broadcast(mapping), "section", "category_id", 7).select("id", "section", "category_id")


@query("SELECT a.id, s.id AS target_id, CASE WHEN s.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM articles a LEFT JOIN (SELECT headline, min(id) AS id FROM articles WHERE id % 2 = 0 GROUP BY 1) s USING (headline) WHERE a.id % 2 = 1", ARTICLES)
def j10_headline_action(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", "headline")
    return J.headline_action(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).select("id", "target_id", "action")


@query("SELECT DISTINCT job, CASE WHEN job IN ('s1', 's4') THEN 0 ELSE 1 END AS autorun FROM runs", RUNS)
def j11_setting_default(spark, sf_dir):
    settings = spark.createDataFrame([("s1", 0), ("s4", 0)], "job string, autorun int")
    return J.lookup_id(runs(spark, sf_dir).select("job").distinct(), F.broadcast(settings), "job", "autorun", 1)


@query("SELECT id FROM articles a JOIN rechecked r USING (id) WHERE trim(regexp_replace(r.content, '\\s+', ' ', 'g')) <> '' AND trim(regexp_replace(r.content, '\\s+', ' ', 'g')) <> trim(regexp_replace(a.content, '\\s+', ' ', 'g'))", ARTICLES, RECHECKED)
def j12_changed(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return J.changed_rows(rows, rechecked(rows)).select("id")


@query("SELECT cluster_id, v FROM (SELECT cluster_id, round(sum(list_sum(v)), 6) AS v FROM members JOIN vectors ON vec_id = article_id GROUP BY 1)", CLUSTERS)
def j15_member_vectors(spark, sf_dir):
    m = clusters(spark, sf_dir)[1]
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("article_id"), total.alias("t"))
    return m.join(own, "article_id").groupBy("cluster_id").agg(F.round(F.sum("t"), 6).alias("v"))


FINGERPRINTS = """words AS (SELECT doc_id AS id, ('0x' || md5(w)[:15])::BIGINT AS h FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))) AS w FROM documents)),
  bits AS (SELECT id, i, 2 * sum((h >> i) & 1) > count(*) AS b FROM words, (SELECT range AS i FROM range(0, 60)) GROUP BY id, i),
  fingerprints AS (SELECT id, sum(CASE WHEN b THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS fp FROM bits GROUP BY id)"""


@query("SELECT doc_id AS id, coalesce(fp, 0) AS fp FROM documents LEFT JOIN fingerprints ON id = doc_id", FINGERPRINTS)
def j16_simhash(spark, sf_dir):
    return J.simhash(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


@query("""SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, bit_count(xor(x.fp, y.fp))::INTEGER AS distance FROM firsts x JOIN firsts y ON x.id < y.id WHERE bit_count(xor(x.fp, y.fp)) < 6
  UNION ALL SELECT m, id, 0 FROM (SELECT id, min(id) OVER (PARTITION BY fp) AS m FROM fingerprints) WHERE m < id""", FINGERPRINTS, "firsts AS (SELECT fp, min(id) AS id FROM fingerprints GROUP BY fp)")
def j16_hamming_pairs(spark, sf_dir):
    return J.hamming_pairs(J.simhash(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")))


@query("SELECT c.cluster_id, string_agg(m.article_id || ':' || left(headline, 20), '|' ORDER BY is_primary DESC, m.content_length DESC, m.article_id) AS members FROM event_clusters c JOIN members m USING (cluster_id) JOIN articles a ON a.id = m.article_id GROUP BY 1", CLUSTERS)
def j17_cluster_detail(spark, sf_dir):
    detail = J.cluster_detail(*clusters(spark, sf_dir), articles(spark, sf_dir))
    line = F.transform("members", lambda m: F.concat(m["article_id"].cast("string"), F.lit(":"), F.substring(m["headline"], 1, 20)))
    return detail.select("cluster_id", F.array_join(line, "|").alias("members"))


@query("SELECT site, count(*) AS n, sum(is_active)::BIGINT AS n_active FROM categories GROUP BY 1", CATEGORIES)
def j13_status_map(spark, sf_dir):
    status = J.status_map(categories(spark, sf_dir))
    return status.select("site", F.size("status").cast("long").alias("n"), F.size(F.filter(F.map_values("status"), lambda x: x)).cast("long").alias("n_active"))


@query("SELECT asset_id, arg_min(vec_id, (-s, vec_id)) AS vec_id, max(s) AS score FROM (SELECT vec_id, asset_id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 0)), 4) AS s FROM vectors) GROUP BY 1 HAVING max(s) >= 0.05 ORDER BY score DESC, vec_id LIMIT 20", VECTORS)
def w1_best_per_asset(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = F.array(*(F.lit(x) for x in v.filter("vec_id = 0").first()["v"]))
    scored = v.select("asset_id", "vec_id", F.round(cosine(F.col("v"), q), 4).alias("score"))
    return W.best_per_key(scored, "asset_id", "score", "vec_id", 0.05, 20).select("asset_id", "vec_id", "score")


@query("""SELECT event_id, job FROM (SELECT *, max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY event_id) AS ended FROM
  (SELECT *, count(*) FILTER (old) OVER (PARTITION BY job, island ORDER BY event_id) AS streak FROM (SELECT *, count(*) FILTER (NOT old) OVER (PARTITION BY job ORDER BY event_id) AS island
    FROM (SELECT event_id, job, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value < 30 END AS old FROM runs)))) WHERE ended = 0 AND NOT coalesce(old, false)""", RUNS)
def w2_consecutive_old(spark, sf_dir):
    old = F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value") < 30)
    return W.until_consecutive_old(runs(spark, sf_dir), "job", "event_id", old).select("event_id", "job")


@query("SELECT headline, min(id) AS id FROM articles GROUP BY 1", ARTICLES)
def w3_first_of_each(spark, sf_dir):
    return W.first_of_each(articles(spark, sf_dir).select("headline", "id"), "headline", "id")


@query("SELECT job, event_id, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rank FROM runs) WHERE rank <= 100", RUNS)
def w4_last_lines(spark, sf_dir):
    return W.last_n(runs(spark, sf_dir).select("job", "event_id", "line", "ts"), "job", 100, "ts", "event_id").drop("ts")


@query("SELECT job, arg_max(regexp_extract(line, 'STATUS:([^:]+):', 1), (ts, event_id)) AS state FROM runs WHERE line LIKE '[STATUS:%' GROUP BY 1", RUNS)
def w5_latest_state(spark, sf_dir):
    states = runs(spark, sf_dir).withColumn("state", X.status_state(F.col("line"))).filter("state IS NOT NULL")
    return W.latest_of_each(states, "job", "state", "ts", "event_id")


@query("SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS new_id FROM (SELECT label, count(*) AS n FROM vectors GROUP BY 1)", VECTORS)
def w7_renumbered(spark, sf_dir):
    counts = vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return W.numbered(counts, "number", F.desc("n"), F.asc("label")).select("label", "n", (F.col("number") - 1).alias("new_id"))


@query("""SELECT s.asset_id, a.a_id, a.a_score, arg_min(vec_id, (-sb, vec_id)) AS b_id, max(sb) AS b_score FROM s JOIN (SELECT asset_id, arg_min(vec_id, (-sa, vec_id)) AS a_id, max(sa) AS a_score FROM s GROUP BY 1) a USING (asset_id) WHERE vec_id <> a_id GROUP BY ALL""",
       VECTORS, "s AS (SELECT vec_id, asset_id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 0)), 4) AS sa, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 2)), 4) AS sb FROM vectors)")
def w8_second_entity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = {r["vec_id"]: F.array(*(F.lit(x) for x in r["v"])) for r in v.filter("vec_id IN (0, 2)").collect()}
    scores = v.select("asset_id", "vec_id", F.round(cosine(F.col("v"), q[0]), 4).alias("score_a"), F.round(cosine(F.col("v"), q[2]), 4).alias("score_b"))
    return W.second_entity_best(scores)


@query("SELECT id, published_at, (SELECT count(*) FROM articles) AS total, ceil((SELECT count(*) FROM articles) / 25)::BIGINT AS pages FROM articles ORDER BY published_at DESC, id DESC LIMIT 25 OFFSET 50", ARTICLES)
def o1_page(spark, sf_dir):
    return W.page(articles(spark, sf_dir).select("id", "published_at"), 3, 25, F.desc("published_at"), F.desc("id"))


@query("SELECT id, page, number FROM (SELECT id, (number - 1) // 25 + 1 AS page, number, max(number) OVER () AS n FROM (SELECT id, row_number() OVER (ORDER BY published_at DESC, id DESC) AS number FROM articles)) WHERE page = n // 50", ARTICLES)
def o1_deep_page(spark, sf_dir):
    """The page in the middle of the listing, which is laid out by pages."""
    rows = articles(spark, sf_dir).select("id", "published_at")
    listing = W.pages(rows, 25, F.desc("published_at"), F.desc("id"))
    return W.page_of(listing, rows.count() // 50).select("id", "page", "number")


@query("SELECT id, headline FROM articles ORDER BY id DESC LIMIT 200", ARTICLES)
def o2_newest(spark, sf_dir):
    return articles(spark, sf_dir).select("id", "headline").orderBy(F.desc("id")).limit(200)


@query("SELECT id, headline FROM articles WHERE id > 100 ORDER BY id LIMIT 50", ARTICLES)
def o3_after_offset(spark, sf_dir):
    return articles(spark, sf_dir).select("id", "headline").filter("id > 100").orderBy("id").limit(50)


@query("SELECT cluster_id, article_count, event_date FROM event_clusters ORDER BY event_date DESC, article_count DESC, cluster_id", CLUSTERS)
def o4_cluster_order(spark, sf_dir):
    return clusters(spark, sf_dir)[0].select("cluster_id", "article_count", "event_date").orderBy(F.desc("event_date"), F.desc("article_count"), "cluster_id")


@query("SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END AS t FROM runs) ORDER BY t, event_id", RUNS)
def o6_unknown_first(spark, sf_dir):
    known = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return runs(spark, sf_dir).select("event_id", F.coalesce(known, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).alias("t")).orderBy("t", "event_id")


@query("SELECT cluster_id, article_id, is_primary, content_length FROM members", CLUSTERS)
def o7_member_order(spark, sf_dir):
    return clusters(spark, sf_dir)[1].select("cluster_id", "article_id", "is_primary", "content_length").orderBy("cluster_id", F.desc("is_primary"), F.desc("content_length"), "article_id")


@query("SELECT vec_id FROM vectors WHERE vec_id % 5 <> 0", VECTORS)
def u1_unprocessed(spark, sf_dir):
    from ..operators.vector_search import unprocessed

    v = vectors(spark, sf_dir).select("vec_id")
    return unprocessed(v, v.filter("vec_id % 5 = 0"), "vec_id")


@query("SELECT vec_id, asset_id FROM vectors UNION ALL SELECT vec_id + 100000, asset_id FROM vectors WHERE vec_id < 10", VECTORS)
def u2_appended(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "asset_id")
    return v.unionByName(v.filter("vec_id < 10").withColumn("vec_id", F.col("vec_id") + 100_000))


@query("SELECT source_site, min(p) AS p FROM (SELECT source_site, 0 AS p FROM articles UNION ALL SELECT 'src' || range, 1 FROM range(0, 30)) GROUP BY 1", ARTICLES)
def u3_ordered_union(spark, sf_dir):
    found = articles(spark, sf_dir).select("source_site", F.lit(0).alias("p"))
    listed = spark.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_site"), F.lit(1).alias("p"))
    return W.first_of_each(found.unionByName(listed), "source_site", "p")


_WORDS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT a.id, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM t a JOIN t b ON b.id = a.id + 1", ARTICLES, f"t AS (SELECT id, {_WORDS.format('content')} AS w FROM articles)")
def u4_jaccard(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", X.word_set(F.col("content")).alias("words"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("words").alias("other"))
    return rows.join(after, "id").select("id", F.round(X.overlap(F.col("words"), F.col("other")), 6).alias("jaccard"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'new ' || headline ELSE headline END AS headline FROM articles WHERE id % 6 <> 0 OR id % 4 = 0", ARTICLES)
def s10_upsert(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", "headline")
    return M.upsert(rows.filter("id % 6 <> 0"), rows.filter("id % 4 = 0").withColumn("headline", F.concat(F.lit("new "), "headline")), "id")


@query("SELECT headline, id FROM articles WHERE id < 100 UNION ALL SELECT headline, min(id) FROM articles WHERE id >= 100 AND headline NOT IN (SELECT headline FROM articles WHERE id < 100) GROUP BY 1", ARTICLES)
def s11_insert_ignore(spark, sf_dir):
    rows = articles(spark, sf_dir).select("headline", "id")
    return M.insert_ignore(rows.filter("id < 100"), rows.filter("id >= 100"), ["headline"], "id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE tags END AS tags, CASE WHEN id % 5 = 0 THEN 'patched' ELSE section END AS section FROM articles", ARTICLES)
def m1_patch(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", "tags", "section")
    patches = rows.filter("id % 3 = 0 OR id % 5 = 0").select("id", F.lit(None).cast("string").alias("tags"), (F.col("id") % 3 == 0).alias("has_tags"), F.lit("patched").alias("section"), (F.col("id") % 5 == 0).alias("has_section"))
    return M.patch(rows, patches, "id", ["tags", "section"])


@query("SELECT keyword_id, article_id FROM matches WHERE keyword_id <> 1", ARTICLES, KEYWORD_ROWS, MATCHES)
def m2_delete(spark, sf_dir):
    return M.delete(_matches(spark, sf_dir), keywords(spark).filter("id = 1").select(F.col("id").alias("keyword_id")), "keyword_id")


@query("SELECT id FROM articles WHERE id <> 7", ARTICLES)
def m2_delete_one(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id")
    return M.delete(rows, spark.createDataFrame([(7,)], "id long"), "id")


@query("SELECT id FROM articles WHERE id NOT IN (SELECT item_id * 3 FROM benchmark)", ARTICLES)
def m2_delete_list(spark, sf_dir):
    return M.delete(articles(spark, sf_dir).select("id"), table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("id")), "id")


@query("SELECT id FROM articles WHERE false", ARTICLES)
def m2_delete_all(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id")
    return M.delete(rows, rows, "id")


@query("SELECT id, CASE WHEN site = 'building' THEN 1 - is_active ELSE is_active END AS is_active FROM categories", CATEGORIES)
def m3_toggle(spark, sf_dir):
    return M.toggle(categories(spark, sf_dir), F.col("site") == "building").select("id", "is_active")


@query("SELECT id, EXISTS (FROM categories x WHERE x.id % 2 = 0 AND x.site = c.site AND x.category_url = c.category_url) AS rejected FROM categories c WHERE id % 2 = 1", CATEGORIES)
def m4_insert_rejecting(spark, sf_dir):
    rows = categories(spark, sf_dir).select("id", "site", "category_url")
    added, rejected = M.insert_rejecting(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["site", "category_url"])
    return added.select("id", F.lit(False).alias("rejected")).unionByName(rejected.select("id", F.lit(True).alias("rejected")))


@query("""SELECT source_url, CASE WHEN id % 5 = 0 AND id % 2 = 1 THEN 'Failed to scrape' ELSE headline END AS headline, CASE WHEN id % 5 = 0 THEN 'Failed' ELSE scraping_status END AS scraping_status,
  (CASE WHEN id % 2 = 1 THEN 0 ELSE processing_count END + (id % 5 = 0)::INT)::BIGINT AS processing_count, CASE WHEN id % 5 = 0 THEN 'Error: timeout' ELSE tags END AS tags FROM articles WHERE id % 2 = 0 OR id % 5 = 0""", ARTICLES)
def m5_record_failures(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return M.record_failures(rows.filter("id % 2 = 0"), rows.filter("id % 5 = 0").select("source_url", F.lit("timeout").alias("error")))


@query("SELECT id, headline, length(r.content) AS n, CASE WHEN id % 2 = 0 THEN 'Success' ELSE scraping_status END AS scraping_status, processing_count + (id % 2 = 0)::INT AS processing_count FROM articles a JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN x.content ELSE y.content END AS content FROM rechecked x JOIN (SELECT id, content FROM articles) y USING (id)) r USING (id)", ARTICLES, RECHECKED)
def m6_record_successes(spark, sf_dir):
    rows = articles(spark, sf_dir)
    done = M.record_successes(rows, rechecked(rows).filter("id % 2 = 0"))
    return done.select("id", "headline", F.length("content").cast("long").alias("n"), "scraping_status", "processing_count")


@query("SELECT id, length(content) + CASE WHEN id % 10 = 1 THEN 8 ELSE 0 END AS n, CASE WHEN id % 10 = 1 THEN TIMESTAMP '2024-06-01' END AS updated_at, CASE WHEN id % 10 = 1 THEN 1 ELSE 0 END AS updates FROM articles", ARTICLES)
def m7_recheck(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stored = rows.select("id", "headline", "content", F.lit(None).cast("int").alias("updates"))
    done = M.apply_recheck(stored, J.changed_rows(rows, rechecked(rows)), F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))
    return done.select("id", F.length("content").cast("long").alias("n"), "updated_at", "updates")


@query("SELECT id FROM articles WHERE id % 3 = 0 AND id % 9 <> 0", ARTICLES)
def m8_fan_out(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", "source_url")
    return M.fan_out(rows.filter("id % 3 = 0"), rows.filter("id % 9 = 0"), "source_url").select("id")


@query("""SELECT cluster_id, CASE WHEN cluster_id = t THEN n ELSE 0 END AS article_count, CASE WHEN cluster_id = t THEN 'active' ELSE 'merged' END AS status FROM two, (SELECT sum(article_count)::BIGINT AS n, arg_min(cluster_id, (-article_count, cluster_id)) AS t FROM two)""", CLUSTERS, "two AS (SELECT * FROM event_clusters ORDER BY article_count DESC, cluster_id LIMIT 2)")
def m9_merge_clusters(spark, sf_dir):
    c, m = clusters(spark, sf_dir)
    largest = [r["cluster_id"] for r in c.orderBy(F.desc("article_count"), "cluster_id").limit(2).collect()]
    if len(largest) == 2:  # one alone is merged with nothing
        c, _ = M.merge_clusters(c, m, *largest)
    return c.filter(F.col("cluster_id").isin(largest)).select("cluster_id", "article_count", "status")


@query("SELECT cluster_id, CASE WHEN article_count = 2 THEN 'archived' ELSE status END AS status FROM event_clusters", CLUSTERS)
def m10_archive(spark, sf_dir):
    return M.archive(clusters(spark, sf_dir)[0], F.col("article_count") == 2).select("cluster_id", "status")


@query("SELECT cluster_id, count(*) AS n FROM members WHERE article_id % 2 = 0 OR is_primary GROUP BY 1", CLUSTERS)
def m11_remove_members(spark, sf_dir):
    return M.remove_members(clusters(spark, sf_dir)[1], F.col("article_id") % 2 != 0).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT article_id, cluster_id, CASE WHEN cluster_id = (SELECT min(cluster_id) FROM members) THEN article_id = (SELECT max(article_id) FROM members WHERE cluster_id = (SELECT min(cluster_id) FROM members)) ELSE is_primary END AS is_primary FROM members", CLUSTERS)
def m12_change_primary(spark, sf_dir):
    c, m = clusters(spark, sf_dir)
    first = m.groupBy("cluster_id").agg(F.max("article_id").alias("a")).orderBy("cluster_id").first()
    return M.change_primary(c, m, first["cluster_id"], first["a"])[1].select("article_id", "cluster_id", "is_primary")


@query("SELECT site AS label, CASE WHEN site = 'machinery' THEN -1 ELSE count(*) END AS n FROM categories GROUP BY site HAVING site <> 'machinery' UNION ALL SELECT 'MACHINERY', -1", CATEGORIES)
def m13_labels(spark, sf_dir):
    counts = categories(spark, sf_dir).groupBy(F.col("site").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return M.upsert_labels(counts, spark.createDataFrame([("MACHINERY", -1)], "label string, n long"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, bit_count(xor(vec_id, 12345::BIGINT))::INTEGER AS bits FROM vectors", VECTORS)
def f38_f39_norm_hamming(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(norm(F.col("v")), 6).alias("norm"), hamming(F.col("vec_id"), F.lit(12345).cast("long")).alias("bits"))
