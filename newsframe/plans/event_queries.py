"""Queries of sources (S), clusters (A, V), vector searches (V) and streams (T)."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine
from ..operators import clustering as C
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import reports as A
from ..operators import similarity as P
from ..operators import vector_search as V
from ..sources import readers as S
from ..sources.checkpoints import shared_folder
from ..streaming import monitor as T
from .registry import query
from .table_queries import FINGERPRINTS, MATCHES
from .views import ARTICLES, CLUSTERS, KEYWORD_ROWS, RUNS, VECTORS, articles, as_of, as_runs, clusters, keywords, runs, table, vectors


@query("SELECT id, headline, source_url, tags, processing_count FROM articles", ARTICLES)
def s1_articles(spark, sf_dir):
    return articles(spark, sf_dir).select("id", "headline", "source_url", "tags", "processing_count")


@query("SELECT job AS scraper, event_type AS category, date_trunc('second', max(runs.ts)) AS ts FROM runs JOIN events e USING (event_id) GROUP BY ALL", RUNS)
def s2_watermarks(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    marks = runs(spark, sf_dir).join(kinds, "event_id").groupBy("job", "event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    states = marks.groupBy(F.col("job").alias("scraper")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "t")))).alias("state"))
    return S.watermark_rows(states)


@query("SELECT DISTINCT job, CASE job WHEN 's1' THEN 60 WHEN 's2' THEN 300 WHEN 's4' THEN 900 ELSE 600 END AS seconds FROM runs", RUNS)
def s3_cycle_seconds(spark, sf_dir):
    config = F.lit('{"global_cycle_time": null, "scrapers": {"s1": 60, "s2": 300, "s3": null}}')
    return runs(spark, sf_dir).select("job").distinct().select("job", S.cycle_seconds(config, F.col("job"), own_defaults={"s2": 120, "s4": 900, "s5": 0}).alias("seconds"))


@query("SELECT page_id, url, length(html)::INTEGER AS n FROM pages")
def s4_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"))


@query("SELECT 'https://x.example/en/' || page_id AS url, CASE WHEN page_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(page_id) END AS lastmod FROM pages WHERE page_id % 5 = 0 OR page_id >= 24 ORDER BY lastmod DESC NULLS LAST, url LIMIT 200")
def s5_sitemap(spark, sf_dir):
    i = F.col("page_id")
    day = F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, int(page_id))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lastmod = F.when(i % 5 == 0, "<lastmod>soon</lastmod>").otherwise(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")))
    # every other page writes names with a prefix and the address as CDATA; one in three has a comment that holds an entry; a text that is no XML stands beside them
    plain = F.concat(F.lit("<urlset><url><loc>https://x.example/about</loc></url><url><loc>https://x.example/en/"), i.cast("string"), F.lit("</loc>"), lastmod, F.lit("</url></urlset>"))
    named = F.regexp_replace(F.regexp_replace(plain, r"<loc>(.*?)</loc>", r"<loc><![CDATA[$1]]></loc>"), r"<(/?)(urlset|url|loc|lastmod)>", r"<$1s:$2>")
    named = F.regexp_replace(named, "^<s:urlset>", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">')
    comment = F.when(i % 3 == 0, "<!-- <url><loc>https://x.example/en/1</loc></url> -->").otherwise("")
    xml = F.regexp_replace(F.when(i % 2 == 0, named).otherwise(plain), "(?=</(?:s:)?urlset>)", comment)
    pages = table(spark, sf_dir, "pages").select(xml.alias("xml"))
    return S.sitemap_entries(pages.unionByName(spark.createDataFrame([("<urlset><url><loc>https://x.example/en/7",), (None,), ("",)], "xml string")), F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"))


@query("SELECT 'story-' || event_id AS slug, date_trunc('millisecond', ts) AS published_at FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-10'")
def s6_collection(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "error", "ad").otherwise("story")
    item = F.struct(kind.alias("type"), F.struct(F.concat(F.lit("story-"), F.col("event_id").cast("string")).alias("slug"), ms.alias("published-at")).alias("story"))
    payload = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return S.collection_stories(payload, 1_704_844_800_000)


@query("SELECT page_id AS id, (p - 1)::INTEGER AS position, CASE p WHEN 1 THEN 'a' || page_id ELSE 'b' END AS slug FROM pages, (VALUES (1), (2)) AS v(p)")
def s7_indexed_slugs(spark, sf_dir):
    a = F.concat(F.lit('["{\\"news\\": 1}", "[2, 3, 2]", "{\\"slug\\": 4}", "{\\"slug\\": 5}", "a'), F.col("page_id").cast("string"), F.lit('", "b"]'))
    return S.indexed_slugs(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), a.alias("payload")), "news")


@query("SELECT event_id, user_id, event_type FROM events")
def s8_log_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    lines = T.read_files(spark, f"{sf_dir}/events.parquet", schema).select("event_id", "user_id", "event_type")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{T.run_to_end(lines)}/batch=*")


@query()
def s9_assets(spark, sf_dir):
    """The Parquet files of the tables' folder, by name and length."""
    return S.assets(spark, sf_dir, ("parquet",)).select(F.regexp_extract("path", "([^/]+/)?[^/]+$", 0).alias("name"), "length")


@query("SELECT job, n, run FROM (SELECT job, count(*) AS n FROM runs GROUP BY 1), (VALUES (1), (2)) AS v(run)", RUNS)
def s12_append_log(spark, sf_dir):
    counts = runs(spark, sf_dir).groupBy("job").agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    for run in (1, 2):
        S.append_log(counts.withColumn("run", F.lit(run)), path)
    return spark.read.schema("job string, n long, run int").parquet(path)


@query("SELECT count(*) AS groups, round(avg(n), 6) AS avg_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM members GROUP BY cluster_id)", CLUSTERS)
def a9_cluster_stats(spark, sf_dir):
    return A.group_sizes(clusters(spark, sf_dir)[1], "cluster_id")


@query("SELECT count(DISTINCT article_id) AS n FROM members", CLUSTERS)
def a10_clustered(spark, sf_dir):
    return clusters(spark, sf_dir)[1].agg(F.count_distinct("article_id").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (article_id % 2 = 0) AS unread FROM matches", ARTICLES, KEYWORD_ROWS, MATCHES)
def a8_match_stats(spark, sf_dir):
    found = J.keyword_matches(articles(spark, sf_dir), keywords(spark))
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("article_id") % 2 == 0).alias("unread"))


@query("SELECT source_site, count(*) AS match_count FROM matches JOIN articles ON id = article_id GROUP BY 1", ARTICLES, KEYWORD_ROWS, MATCHES)
def a8_matches_by_source(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return A.matches_by_source(J.keyword_matches(rows, keywords(spark)), rows)


@query("SELECT cluster_id, cluster_name, primary_article_id, article_count, event_date, category, tags, status FROM event_clusters", CLUSTERS)
def v6_assembly(spark, sf_dir):
    """Also A18 to A20: tags, date and primary of each cluster."""
    return clusters(spark, sf_dir)[0]


@query("SELECT cluster_id, article_id FROM comps", CLUSTERS)
def v3_components(spark, sf_dir):
    return C.similarity_clusters(vectors(spark, sf_dir), 0.40)


@query("SELECT m.cluster_id, m.article_id, round(list_cosine_similarity(x.v, p.v), 4) AS similarity_to_primary FROM members m JOIN event_clusters c USING (cluster_id) JOIN vectors x ON x.vec_id = m.article_id JOIN vectors p ON p.vec_id = primary_article_id", CLUSTERS)
def v7_similarity_to_primary(spark, sf_dir):
    c, m = clusters(spark, sf_dir)
    return C.with_similarity_to_primary(m, c, vectors(spark, sf_dir)).select("cluster_id", "article_id", "similarity_to_primary")


_HEADLINE_WORDS = "words AS (SELECT id, list_distinct(list_filter(string_split_regex(headline, '\\s+'), lambda w: w <> '')) AS w FROM articles)"
_OVERLAP = "CASE WHEN len(x.w) + len(y.w) = 0 THEN 0.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END"


@query(f"""SELECT a, b, score >= 0.93 OR (score >= 0.45 AND j >= 0.10) OR (j >= 0.60 AND score >= 0.75) OR (j >= 0.35 AND score >= 0.80) AS accepted
  FROM (SELECT a, b, score, {_OVERLAP} AS j FROM pairs JOIN words x ON x.id = a JOIN words y ON y.id = b)""", CLUSTERS, _HEADLINE_WORDS)
def v5_acceptance(spark, sf_dir):
    own = articles(spark, sf_dir)
    pairs = P.similar_pairs(vectors(spark, sf_dir), 0.40)
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("headline").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("headline").alias("y")), "b")
    return both.select("a", "b", C.accepted(F.col("score"), X.jaccard(F.col("x"), F.col("y")), 0.45).alias("accepted"))


#: The members of each cluster in the order of refinement, with the cosine and the overlap to all of them; and one step after the other.
_ORDERED = """ordered AS (SELECT cluster_id, article_id, v, w, row_number() OVER (PARTITION BY cluster_id ORDER BY first DESC, published_at DESC, id DESC)::INTEGER AS n
    FROM (SELECT c.cluster_id, c.article_id, x.v, s.w, a.id, a.published_at, row_number() OVER (PARTITION BY c.cluster_id ORDER BY a.content_length DESC, a.published_at DESC, a.id DESC) = 1 AS first
      FROM comps c JOIN articles a ON a.id = c.article_id JOIN vectors x ON x.vec_id = c.article_id JOIN words s ON s.id = a.id)),
  sides AS (SELECT x.cluster_id, x.n, list(list_cosine_similarity(x.v, y.v) ORDER BY y.n) AS score, list(""" + _OVERLAP + """ ORDER BY y.n) AS share FROM ordered x JOIN ordered y ON x.cluster_id = y.cluster_id GROUP BY ALL),
  steps AS (SELECT cluster_id, n, [1] AS taken FROM sides WHERE n = 1 UNION ALL
    SELECT cluster_id, n, CASE WHEN best >= 0.93 OR (best >= 0.42 AND j >= 0.10) OR (j >= 0.60 AND best >= 0.75) OR (j >= 0.35 AND best >= 0.80) THEN list_append(taken, n) ELSE taken END AS taken
    FROM (SELECT *, CASE WHEN best > 0 THEN share[taken[list_position(near, best)]] ELSE 0 END AS j FROM (SELECT t.cluster_id, s.n, taken, share, list_transform(taken, lambda i: score[i]) AS near, greatest(0.0, list_max(list_transform(taken, lambda i: score[i]))) AS best FROM steps t JOIN sides s ON s.cluster_id = t.cluster_id AND s.n = t.n + 1))),
  refined AS (SELECT cluster_id, article_id FROM (SELECT cluster_id, arg_max(taken, n) AS taken FROM steps GROUP BY 1) t JOIN ordered o USING (cluster_id) WHERE len(taken) >= 2 AND list_contains(taken, o.n))"""


def _to_refine(spark, sf_dir):
    own = articles(spark, sf_dir).select(F.col("id").alias("article_id"), "headline", "content_length", (-F.col("id")).alias("position"))  # later articles have larger ids
    found = C.similarity_clusters(vectors(spark, sf_dir), 0.40)
    return found.join(own, "article_id").join(vectors(spark, sf_dir).select(F.col("vec_id").alias("article_id"), "v"), "article_id")


@query("SELECT cluster_id, article_id FROM refined", CLUSTERS, _HEADLINE_WORDS, _ORDERED)
def v4_refined(spark, sf_dir):
    """Members that stay after greedy refinement."""
    return C.refine(_to_refine(spark, sf_dir), 0.42)


@query("SELECT doc_id, 256::INTEGER AS n, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, sha256(coalesce(text, '')) AS text_hash FROM documents")
def v1_embedded(spark, sf_dir):
    """Hashed and weighted words of each article as a vector: its size and length, and the hash of its text."""
    done = C.embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("embedding").alias("n"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), "text_hash")


_VOWELS = "aeiou"


def _letter_vectors(texts):
    """An encoder: how often each vowel stands in a text, brought to length 1."""
    out = []
    for text in texts:
        counts = [text.count(c) for c in _VOWELS]
        length = sum(n * n for n in counts) ** 0.5 or 1.0
        out.append([n / length for n in counts])
    return out


_COUNTS = "[" + ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in _VOWELS) + "]"


@query(f"""SELECT doc_id, array_to_string(list_transform(c, lambda x: round(x / CASE WHEN list_dot_product(c, c) = 0 THEN 1 ELSE sqrt(list_dot_product(c, c)) END * 1000)::BIGINT), ' ') AS v, sha256(t) AS text_hash
  FROM (SELECT doc_id, t, list_transform({_COUNTS}, lambda x: x::DOUBLE) AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def v1_encoded(spark, sf_dir):
    """The vectors of an encoder that the caller gives, in thousandths."""
    done = C.embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), encoder=_letter_vectors)
    return done.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("long").cast("string")), " ").alias("v"), "text_hash")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE 'changed' END AS why FROM articles WHERE id % 5 IN (0, 1)", ARTICLES)
def v2_to_embed(spark, sf_dir):
    text = X.embedding_text(F.col("headline"), F.col("actual_headline"), F.col("content"))
    rows = articles(spark, sf_dir)
    stored = rows.filter("id % 5 <> 0").select(F.col("id").alias("article_id"), F.lit("small").alias("embedding_model"), F.when(F.col("id") % 5 == 1, "old").otherwise(X.text_hash(text)).alias("text_hash"))
    return C.to_embed(rows, stored, "small", text).select("id", "why")


@query("SELECT m.cluster_id, count(*) AS article_count, min(published_at)::DATE AS event_date, 1::BIGINT AS runs, (SELECT count(DISTINCT cluster_id) FROM refined) AS clusters_created FROM refined m JOIN articles a ON a.id = m.article_id GROUP BY 1", CLUSTERS, _HEADLINE_WORDS, _ORDERED)
def v8_full_run(spark, sf_dir):
    """Window (all the time there is), components, refinement, assembly, clusters written over the old ones, and the log of the run."""
    rows = articles(spark, sf_dir)
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    found, _ = C.full_run(rows, vectors(spark, sf_dir).select("vec_id", "v"), as_of(rows), 24 * 365 * 1000, folder, 0.40, 0.42)
    log = spark.read.parquet(f"{folder}/history").agg(F.count(F.lit(1)).alias("runs"), F.max("clusters_created").alias("clusters_created"))
    return found.select("cluster_id", "article_count", "event_date").join(F.broadcast(log), F.lit(True))


@query("SELECT cluster_id, cluster_name, article_count FROM event_clusters WHERE article_count >= 3 AND lower(cluster_name) LIKE '%the%'", CLUSTERS)
def v9_cluster_search(spark, sf_dir):
    return clusters(spark, sf_dir)[0].filter((F.col("article_count") >= 3) & F.lower("cluster_name").contains("the")).select("cluster_id", "cluster_name", "article_count")


@query("""SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY content_length DESC, article_id) AS rank, article_id, source_site, content_length, is_primary, round(list_cosine_similarity(x.v, p.v), 4) AS similarity_to_primary
  FROM members m JOIN event_clusters c USING (cluster_id) JOIN vectors x ON x.vec_id = article_id JOIN vectors p ON p.vec_id = primary_article_id WHERE c.article_count >= 3""", CLUSTERS)
def v9_coverage(spark, sf_dir):
    c, m = clusters(spark, sf_dir)
    return C.coverage(c, C.with_similarity_to_primary(m, c, vectors(spark, sf_dir)))


@query(f"""SELECT a, b, CASE WHEN score >= 0.80 AND j >= 0.12 THEN 'PASS' WHEN j >= 0.40 AND score >= 0.68 THEN 'PASS (headline)' WHEN score >= 0.92 THEN 'PASS (content)' ELSE 'FAIL' END AS verdict
  FROM (SELECT x.id AS a, y.id AS b, {_OVERLAP} AS j, (x.id % 4) / 4.0::DOUBLE + 0.25 AS score FROM words x JOIN words y ON y.id = x.id + 1)""", ARTICLES, _HEADLINE_WORDS)
def v10_verdicts(spark, sf_dir):
    """Verdicts on articles that follow each other, with scores as an encoder might give them and the overlap of their headlines."""
    words = articles(spark, sf_dir).select(F.col("id").alias("a"), X.word_set(F.col("headline")).alias("x"))
    both = words.withColumn("b", F.col("a") + 1).join(words.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", C.verdict((F.col("a") % 4) / 4 + 0.25, X.overlap(F.col("x"), F.col("y"))).alias("verdict"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 4) AS full_score, round(list_cosine_similarity(x.v[1:32], y.v[1:32]), 4) AS half_score FROM vectors x JOIN vectors y ON y.vec_id = x.vec_id + 1", VECTORS)
def v10_encoders(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "v")
    both = v.select(F.col("vec_id").alias("a"), F.col("v").alias("x"), (F.col("vec_id") + 1).alias("b")).join(v.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), "b")
    half = lambda c: F.slice(c, 1, 32)
    return both.select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 4).alias("full_score"), F.round(cosine(half("x"), half("y")), 4).alias("half_score"))


def _chosen(spark, sf_dir, condition):
    return [(r["v"], r["confidence"]) for r in vectors(spark, sf_dir).filter(condition).orderBy("vec_id").collect()]


@query("SELECT vec_id, asset_id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 1)), 4) AS score FROM vectors WHERE round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 1)), 4) >= 0.1 ORDER BY score DESC, vec_id LIMIT 15", VECTORS)
def o5_vector_top_k(spark, sf_dir):
    return V.top_k(vectors(spark, sf_dir), _chosen(spark, sf_dir, "vec_id = 1")[0][0], 15, 0.1)


_MEAN = "mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, sum(w * x) / sum(w) AS m FROM (SELECT confidence AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors WHERE {}) GROUP BY i))"


@query("SELECT round(list_sum(list_transform(m, lambda x: x / n)), 6) AS total, round(list_sum(list_transform(m, lambda x: x * x)) / (n * n), 6) AS norm FROM (SELECT m, sqrt(list_dot_product(m, m)) AS n FROM mean)", VECTORS, _MEAN.format("true"))
def a21_mean_vector(spark, sf_dir):
    total = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)
    return V.mean_vector(vectors(spark, sf_dir), "confidence").select(F.round(total, 6).alias("total"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("SELECT count(*) AS n_vectors, count(DISTINCT asset_id) AS n_assets FROM vectors", VECTORS)
def a22_index_metadata(spark, sf_dir):
    return V.index_metadata(vectors(spark, sf_dir))


@query("SELECT label, count(*) AS n FROM vectors GROUP BY 1", VECTORS)
def a23_label_summary(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _fused(condition, least, name="score"):
    return f"SELECT vec_id, asset_id, v, round(0.7 * list_cosine_similarity(v, (SELECT m FROM mean)) + 0.3 * (SELECT max(list_cosine_similarity(vectors.v, q.v)) FROM vectors q WHERE {condition}), 4) AS {name} FROM vectors"


@query(f"SELECT arg_min(vec_id, (-score, vec_id)) AS vec_id, asset_id, max(score) AS score FROM ({_fused('q.vec_id <= 2', 0)}) GROUP BY asset_id HAVING max(score) >= 0.15", VECTORS, _MEAN.format("vec_id <= 2"))
def v11_fused_search(spark, sf_dir):
    score = V.fused_score(F.col("v"), _chosen(spark, sf_dir, "vec_id <= 2"))
    return V.best_assets(vectors(spark, sf_dir), score, 0.15)


def _label_search(spark, sf_dir, condition):
    rows = vectors(spark, sf_dir)
    scored = V.set_scores(rows.select("vec_id", "asset_id", "v"), rows.filter(condition))
    return V.best_assets(scored, F.col("score"), 0.15)


@query(f"SELECT arg_min(vec_id, (-score, vec_id)) AS vec_id, asset_id, max(score) AS score FROM ({_fused('q.label = 3', 0)}) GROUP BY asset_id HAVING max(score) >= 0.15", VECTORS, _MEAN.format("label = 3").replace("confidence AS w", "1.0::DOUBLE AS w"))
def v12_label_search(spark, sf_dir):
    """By every stored vector of a label."""
    return _label_search(spark, sf_dir, "label = 3")


@query(f"SELECT arg_min(vec_id, (-score, vec_id)) AS vec_id, asset_id, max(score) AS score FROM ({_fused('q.label = 7', 0)}) GROUP BY asset_id HAVING max(score) >= 0.15", VECTORS, _MEAN.format("label = 7").replace("confidence AS w", "1.0::DOUBLE AS w"))
def v12_whole_label(spark, sf_dir):
    """The same for another label."""
    return _label_search(spark, sf_dir, "label = 7")


_SCORED = "scored AS (SELECT vec_id, asset_id, v, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 0)), 4) AS score FROM vectors)"
_OTHERS = "others AS (SELECT s.vec_id, s.asset_id, s.v, t.top AS target_score FROM scored s JOIN (SELECT asset_id, arg_min(vec_id, (-score, vec_id)) AS best, max(score) AS top FROM scored GROUP BY 1 HAVING max(score) >= 0.2) t USING (asset_id) WHERE s.vec_id <> t.best)"


@query("SELECT vec_id, asset_id, target_score FROM others", VECTORS, _SCORED, _OTHERS)
def v13_target_assets(spark, sf_dir):
    q = F.array(*(F.lit(x) for x in _chosen(spark, sf_dir, "vec_id = 0")[0][0]))
    return V.target_assets(vectors(spark, sf_dir), cosine(F.col("v"), q), 0.2).select("vec_id", "asset_id", "target_score")


@query("SELECT a AS vec_id, least(a, min(b)) AS group_id FROM reach GROUP BY a", VECTORS, _SCORED, _OTHERS,
       "ends AS (SELECT x.vec_id AS a, y.vec_id AS b FROM others x JOIN others y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.35)", "reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a)")
def v14_groups(spark, sf_dir):
    q = F.array(*(F.lit(x) for x in _chosen(spark, sf_dir, "vec_id = 0")[0][0]))
    others = V.target_assets(vectors(spark, sf_dir), cosine(F.col("v"), q), 0.2)
    return C.similarity_clusters(others, 0.35).select(F.col("article_id").alias("vec_id"), F.col("cluster_id").alias("group_id"))


#: Vector after vector, with each one's group so far and the groups' sums: the cosines to the members before it, and of each group the larger one of mean and members.
_IN_ORDER = """ordered AS (SELECT row_number() OVER (ORDER BY vec_id)::INTEGER AS n, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM others),
  every AS (SELECT list(v ORDER BY n) AS vs, list(vec_id ORDER BY n) AS ids FROM ordered),
  steps AS (SELECT 1 AS n, [1] AS own, [v] AS sums FROM ordered WHERE n = 1 UNION ALL
    SELECT n, CASE WHEN best >= 0.35 THEN list_append(own, list_position(scores, best)::INTEGER) ELSE list_append(own, (len(sums) + 1)::INTEGER) END,
      CASE WHEN best >= 0.35 THEN list_transform(sums, lambda s, k: CASE WHEN k = list_position(scores, best) THEN list_transform(list_zip(s, v), lambda p: p[1] + p[2]) ELSE s END) ELSE list_append(sums, v) END
    FROM (SELECT *, list_max(scores) AS best FROM (SELECT n, v, own, sums, list_transform(sums, lambda s, k: greatest(list_dot_product(s, v) / sqrt(list_dot_product(s, s)),
        coalesce(list_max(list_transform(list_filter(list_zip(own, near), lambda p: p[1] = k), lambda p: p[2])), -1))) AS scores
      FROM (SELECT o.n, o.v, own, sums, list_transform(vs[1:s.n], lambda m: list_dot_product(m, o.v)) AS near FROM steps s JOIN ordered o ON o.n = s.n + 1, every)))),
  first AS (SELECT unnest(ids) AS vec_id, unnest(own) AS g FROM (SELECT own FROM steps ORDER BY n DESC LIMIT 1), every)"""


#: Passes over the groups: the next group that is near the one at hand is taken in, or the next one is at hand; over after a pass that took none in.
_MERGED = """start AS (SELECT sums, list_transform(range(1, len(sums) + 1), lambda k: list_filter(range(1, len(own) + 1), lambda r: own[r] = k)) AS mem FROM (SELECT own, sums FROM steps ORDER BY n DESC LIMIT 1)),
  passes AS (SELECT 0 AS step, 1::BIGINT AS i, 2::BIGINT AS j, false AS took, false AS over, sums, mem FROM start UNION ALL
    SELECT step + 1, CASE WHEN hit IS NOT NULL THEN i WHEN i < len(sums) THEN i + 1 ELSE 1 END, CASE WHEN hit IS NOT NULL THEN hit WHEN i < len(sums) THEN i + 2 ELSE 2 END,
      hit IS NOT NULL OR (i < len(sums) AND took), hit IS NULL AND i >= len(sums) AND NOT took,
      CASE WHEN hit IS NULL THEN sums ELSE list_transform(list_filter(range(1, len(sums) + 1), lambda x: x <> hit), lambda x: CASE WHEN x = i THEN list_transform(list_zip(sums[i], sums[hit]), lambda p: p[1] + p[2]) ELSE sums[x] END) END,
      CASE WHEN hit IS NULL THEN mem ELSE list_transform(list_filter(range(1, len(mem) + 1), lambda x: x <> hit), lambda x: CASE WHEN x = i THEN list_concat(mem[i], mem[hit]) ELSE mem[x] END) END
    FROM (SELECT p.*, list_filter(range(j, len(sums) + 1), lambda x: list_cosine_similarity(sums[i], sums[x]) >= 0.35
        OR list_max(flatten(list_transform(mem[i], lambda a: list_transform(mem[x], lambda b: list_dot_product(vs[a], vs[b]))))) >= 0.35)[1] AS hit FROM passes p, every WHERE NOT over)),
  merged AS (SELECT ids[r] AS vec_id, min(ids[r]) OVER (PARTITION BY g) AS group_id FROM (SELECT unnest(m) AS r, g FROM (SELECT unnest(mem) AS m, unnest(range(1, len(mem) + 1)) AS g FROM passes WHERE over)), every)"""


def _others(spark, sf_dir, least):
    q = F.array(*(F.lit(x) for x in _chosen(spark, sf_dir, "vec_id = 0")[0][0]))
    return V.target_assets(vectors(spark, sf_dir), cosine(F.col("v"), q), least)


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY g) AS group_id FROM first", VECTORS, _SCORED, _OTHERS, _IN_ORDER)
def v14_in_order(spark, sf_dir):
    """Each vector joins the nearest group so far, by mean or member, or starts one."""
    return G.grouped_in_order(_others(spark, sf_dir, 0.2), 0.35)


def _merged(others):
    return G.merged_in_order(G.grouped_in_order(others, 0.35).join(others.select("vec_id", "v"), "vec_id"), 0.35)


@query("SELECT vec_id, group_id FROM merged", VECTORS, _SCORED, _OTHERS, _IN_ORDER, _MERGED)
def v14_merged_groups(spark, sf_dir):
    """The same groups after passes that merge those that have come near, in order."""
    return _merged(_others(spark, sf_dir, 0.2))


_ANY_OTHERS = "others AS (SELECT s.vec_id, s.asset_id, s.v, t.top AS target_score FROM scored s JOIN (SELECT asset_id, arg_min(vec_id, (-score, vec_id)) AS best, max(score) AS top FROM scored GROUP BY 1 HAVING max(score) >= 0.0) t USING (asset_id) WHERE s.vec_id <> t.best)"


@query("""SELECT g.group_id, count(*) AS n_assets, arg_min(vec_id, (-target_score, vec_id)) AS representative
  FROM (SELECT group_id, arg_max(taken, n) AS taken FROM steps GROUP BY 1) g JOIN ordered o USING (group_id) WHERE list_contains(taken, o.n) GROUP BY 1 HAVING count(*) >= 2""", VECTORS, _SCORED, _ANY_OTHERS,
       "ends AS (SELECT x.vec_id AS a, y.vec_id AS b FROM others x JOIN others y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.35)", "reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a)",
       """ordered AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY vec_id)::INTEGER AS n FROM (SELECT group_id, asset_id, min(vec_id) AS vec_id FROM (SELECT a AS vec_id, least(a, min(b)) AS group_id FROM reach GROUP BY a) JOIN others USING (vec_id) GROUP BY ALL) JOIN (SELECT vec_id, v, target_score FROM others) USING (vec_id)),
  sides AS (SELECT x.group_id, x.n, list(list_cosine_similarity(x.v, y.v) ORDER BY y.n) AS score FROM ordered x JOIN ordered y USING (group_id) GROUP BY ALL),
  steps AS (SELECT group_id, n, [1] AS taken FROM sides WHERE n = 1 UNION ALL
    SELECT t.group_id, s.n, CASE WHEN list_max(list_transform(taken, lambda i: score[i])) > 0.3 THEN taken ELSE list_append(taken, s.n) END AS taken FROM steps t JOIN sides s ON s.group_id = t.group_id AND s.n = t.n + 1)""")
def v15_co_occurrence(spark, sf_dir):
    """Groups that come with the target in two assets or more; near copies count once, here from a cosine of 0.3 on, so that there are some."""
    q = F.array(*(F.lit(x) for x in _chosen(spark, sf_dir, "vec_id = 0")[0][0]))
    others = V.target_assets(vectors(spark, sf_dir), cosine(F.col("v"), q), 0.0)
    groups = C.similarity_clusters(others, 0.35).select(F.col("article_id").alias("vec_id"), F.col("cluster_id").alias("group_id"))
    return V.co_occurrence(others, groups, 0.3)


@query("""SELECT g.group_id, count(*) AS n_assets, arg_min(vec_id, (-target_score, vec_id)) AS representative
  FROM (SELECT group_id, arg_max(taken, n) AS taken FROM choices GROUP BY 1) g JOIN placed o USING (group_id) WHERE list_contains(taken, o.n) GROUP BY 1 HAVING count(*) >= 2""", VECTORS, _SCORED, _OTHERS, _IN_ORDER, _MERGED,
       """placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY vec_id)::INTEGER AS n FROM (SELECT group_id, asset_id, min(vec_id) AS vec_id FROM merged JOIN others USING (vec_id) GROUP BY ALL) JOIN (SELECT vec_id, v, target_score FROM others) USING (vec_id)),
  sides AS (SELECT x.group_id, x.n, list(list_cosine_similarity(x.v, y.v) ORDER BY y.n) AS score FROM placed x JOIN placed y USING (group_id) GROUP BY ALL),
  choices AS (SELECT group_id, n, [1] AS taken FROM sides WHERE n = 1 UNION ALL
    SELECT t.group_id, s.n, CASE WHEN list_max(list_transform(taken, lambda i: score[i])) > 0.3 THEN taken ELSE list_append(taken, s.n) END AS taken FROM choices t JOIN sides s ON s.group_id = t.group_id AND s.n = t.n + 1)""")
def v15_merged_groups(spark, sf_dir):
    """Co-occurrence over the merged groups, lone vectors among them."""
    others = _others(spark, sf_dir, 0.2)
    return V.co_occurrence(others, _merged(others), 0.3)


@query("SELECT vec_id, max(s) AS score, CASE WHEN max(s) >= 0.2 THEN arg_min('L' || q, (-s, q)) END AS label FROM (SELECT x.vec_id, q.vec_id AS q, round(list_cosine_similarity(x.v, q.v), 4) AS s FROM vectors x, vectors q WHERE q.vec_id < 5) GROUP BY 1", VECTORS)
def v16_nearest_label(spark, sf_dir):
    labels = [(f"L{i}", v) for i, (v, _) in enumerate(_chosen(spark, sf_dir, "vec_id < 5"))]
    return V.nearest_label(vectors(spark, sf_dir), labels, 0.2)


@query("""SELECT *, round(a_score + b_score, 4) AS total FROM (SELECT s.asset_id, a.a_id, a.a_score, arg_min(vec_id, (-sb, vec_id)) AS b_id, max(sb) AS b_score FROM s JOIN (SELECT asset_id, arg_min(vec_id, (-sa, vec_id)) AS a_id, max(sa) AS a_score FROM s GROUP BY 1) a USING (asset_id) WHERE vec_id <> a_id GROUP BY ALL)
  WHERE a_score >= 0.1 AND b_score >= 0.1 ORDER BY total DESC, asset_id LIMIT 20""", VECTORS, "s AS (SELECT vec_id, asset_id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 1)), 4) AS sa, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 3)), 4) AS sb FROM vectors)")
def v17_pair_search(spark, sf_dir):
    a, b = (F.array(*(F.lit(x) for x in v)) for v, _ in _chosen(spark, sf_dir, "vec_id IN (1, 3)"))
    return V.pair_search(vectors(spark, sf_dir), cosine(F.col("v"), a), cosine(F.col("v"), b), 0.1, 20)


#: 60-bit fingerprints, and row after row whether it is near to one that stays.
_GREEDY = """numbered AS (SELECT doc_id AS id, coalesce(fp, 0) AS fp, row_number() OVER (ORDER BY doc_id)::INTEGER AS n FROM documents LEFT JOIN fingerprints ON id = doc_id),
  steps AS (SELECT 1 AS n, [fp] AS kept, [id] AS ids FROM numbered WHERE n = 1 UNION ALL
    SELECT s.n + 1, CASE WHEN near THEN kept ELSE list_append(kept, fp) END, CASE WHEN near THEN ids ELSE list_append(ids, id) END
    FROM (SELECT s.n, kept, ids, x.id, x.fp, len(list_filter(kept, lambda k: bit_count(xor(k, x.fp)) < 6)) > 0 AS near FROM steps s JOIN numbered x ON x.n = s.n + 1) s)"""


def _fingerprints(spark, sf_dir):
    return J.simhash(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


@query("SELECT unnest(ids) AS id FROM steps WHERE n = (SELECT count(*) FROM numbered)", FINGERPRINTS, _GREEDY)
def v18_index_build(spark, sf_dir):
    """Documents that are not near-duplicates of an earlier one by fingerprint."""
    nothing = spark.createDataFrame([], "id long, fp long")
    index, _, _ = V.build_index(_fingerprints(spark, sf_dir), nothing, nothing)
    return index.select("id")


@query("SELECT count(*) AS n_new, (SELECT len(ids) FROM steps WHERE n = (SELECT count(*) FROM numbered)) AS n_added, count(*) - (SELECT len(ids) FROM steps WHERE n = (SELECT count(*) FROM numbered)) AS n_skipped, (SELECT len(ids) FROM steps WHERE n = (SELECT count(*) FROM numbered)) AS n_index, count(*) AS n_processed FROM numbered", FINGERPRINTS, _GREEDY)
def v18_index_counts(spark, sf_dir):
    """What the build tells of itself, and how many are marked as processed."""
    nothing = spark.createDataFrame([], "id long, fp long")
    _, processed, counts = V.build_index(_fingerprints(spark, sf_dir), nothing, nothing)
    return counts.join(F.broadcast(processed.agg(F.count(F.lit(1)).alias("n_processed"))), F.lit(True))


@query("SELECT unnest(ids) AS id FROM steps WHERE n = (SELECT count(*) FROM numbered)", FINGERPRINTS, _GREEDY)
def v18_index_in_steps(spark, sf_dir):
    """The same by two builds over an index that lies on disk by bands: the second reads what it meets."""
    folder, items = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", _fingerprints(spark, sf_dir)
    half = F.lit(items.agg(F.max("id")).first()[0] // 2)
    first = V.extend_index(folder, items.filter(F.col("id") <= half))
    return first.unionByName(V.extend_index(folder, items.filter(F.col("id") > half))).select("id")


def _article_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    headline = F.substring(F.split("text", "\n", 2)[0], 1, 120)
    return T.read_files(spark, f"{sf_dir}/documents.parquet", schema).select(F.col("doc_id").alias("id"), headline.alias("headline"), F.col("text").alias("content"))


@query("SELECT * FROM matches WHERE article_id > 20", ARTICLES, KEYWORD_ROWS, MATCHES)
def t1_keyword_monitor(spark, sf_dir):
    return T.monitor_keywords(_article_stream(spark, sf_dir), keywords(spark), 20)


@query("SELECT * FROM matches WHERE article_id > (SELECT max(id) - 100 FROM articles)", ARTICLES, KEYWORD_ROWS, MATCHES)
def t2_replay(spark, sf_dir):
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return T.monitor_keywords(_article_stream(spark, sf_dir), keywords(spark), max(0, last - 100))


@query("SELECT count(*) AS attempts, count(*) FILTER (article_id % 2 = 1) AS inserted FROM matches WHERE article_id > (SELECT max(id) - 200 FROM articles)", ARTICLES, KEYWORD_ROWS, MATCHES)
def t3_backfill(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stored = J.keyword_matches(rows.filter("id % 2 = 0"), keywords(spark))
    return T.backfill(rows, keywords(spark), stored)


@query("SELECT event_id, job FROM runs WHERE ts > CASE WHEN job = 's3' THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-25' END", RUNS)
def t4_past_marks(spark, sf_dir):
    marks = spark.createDataFrame([("s3", datetime(2024, 1, 20))], "job string, mark timestamp_ntz")
    return T.past_marks(runs(spark, sf_dir), F.broadcast(marks), "job", datetime(2024, 1, 25)).select("event_id", "job")


@query("SELECT DISTINCT job, CASE WHEN job IN (SELECT job FROM runs WHERE outcome = 'error') THEN TIMESTAMP '2024-01-30' ELSE TIMESTAMP '2024-01-20' END AS mark FROM runs", RUNS)
def t4_new_marks(spark, sf_dir):
    """The jobs that took part in a cycle get its start as mark, the others keep theirs."""
    rows = runs(spark, sf_dir)
    marks = rows.select("job", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'").alias("mark")).distinct()
    return T.new_marks(marks, rows.filter("outcome = 'error'"), "job", datetime(2024, 1, 30))


@query("SELECT event_id FROM runs WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11 12:00:00'", RUNS)
def t5_window(spark, sf_dir):
    return runs(spark, sf_dir).filter(T.in_window(F.col("ts"), datetime(2024, 1, 10), datetime(2024, 1, 10) + timedelta(hours=36))).select("event_id")


@query("""SELECT event_id, greatest_time AS effective FROM (SELECT event_id, CASE WHEN ts > m AND ts <= e THEN ts WHEN modified > m AND modified <= e THEN modified END AS greatest_time
  FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 2 DAYS END AS modified, TIMESTAMP '2024-01-10' AS m, TIMESTAMP '2024-01-14 12:00:00' AS e FROM events)) WHERE greatest_time IS NOT NULL""")
def t6_late_updates(spark, sf_dir):
    """Of a stream the rows that were published or, failing that, modified in the window; a later update of a known key is taken as well."""
    stream = T.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    stream = stream.withColumn("modified", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")))
    taken = T.late_updates(stream, "event_id", "ts", "modified", datetime(2024, 1, 10), datetime(2024, 1, 14, 12), "60 days").select("event_id", F.col("effective").cast("timestamp_ntz").alias("effective"))
    return spark.read.schema("event_id long, effective timestamp_ntz").parquet(f"{T.run_to_end(taken)}/batch=*")


@query("SELECT DISTINCT user_id FROM events")
def t7_stream_dedup(spark, sf_dir):
    stream = T.first_of_key(T.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema), "user_id", "ts", "60 days").select("user_id")
    return spark.read.schema("user_id long").parquet(f"{T.run_to_end(stream)}/batch=*")


@query("SELECT job, count(*) AS lines, count(*) FILTER (line LIKE 'Error%' OR line LIKE '✗%') AS errors, sum(CASE WHEN line LIKE '✓ SUCCESS%' THEN 2 WHEN line LIKE '✓ Inserted%' OR line LIKE '[OK] Updated%' THEN 1 ELSE 0 END)::BIGINT AS processed, arg_max(line, (ts, event_id)) AS latest FROM runs GROUP BY 1", RUNS)
def t8_job_counters(spark, sf_dir):
    batch = runs(spark, sf_dir)
    schema = table(spark, sf_dir, "events").schema
    # one micro-batch a file: the complete state after the last is the batch result
    stream = T.read_files(spark, f"{sf_dir}/events.parquet", schema)
    state = T.run_to_end(T.job_counters(as_runs(stream)), mode="complete")
    counted = spark.read.option("basePath", state).parquet(f"{state}/batch=*")
    last = counted.agg(F.max("batch")).first()[0]
    return counted.filter(F.col("batch") == last).select(T.job_counters(batch).columns)


@query("""SELECT job, count(*) AS lines, count(*) FILTER (line LIKE 'Error%' OR line LIKE '✗%') AS errors, arg_max(regexp_extract(line, 'STATUS:([^:]+):', 1), (ts, event_id)) FILTER (line LIKE '[STATUS:%') AS state,
  arg_max(regexp_extract(line, 'STATUS:[^:]+:(.+?)\\]', 1), (ts, event_id)) FILTER (line LIKE '[STATUS:%') AS detail, md5(string_agg(line, chr(10) ORDER BY ts, event_id) FILTER (rank <= 100)) AS tail
  FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rank FROM runs) GROUP BY 1""", RUNS)
def t8_job_tails(spark, sf_dir):
    """Latest state and last hundred lines of each job, kept over a stream."""
    stream = T.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, 1)
    out = T.run_to_end(T.job_tails(as_runs(stream)), mode="update", state_store=T.ROCKS)
    told = spark.read.schema("job string, lines long, errors long, state string, detail string, tail array<string>, batch int").option("basePath", out).parquet(out)
    last = told.groupBy("job").agg(F.max_by(F.struct("lines", "errors", "state", "detail", F.md5(F.array_join("tail", "\n")).alias("tail")), "batch").alias("r"))
    return last.select("job", "r.*")


_RETRIES = """SELECT key, CASE WHEN f <= 10 THEN f ELSE least(n, 10) END::INTEGER AS attempts, CASE WHEN f <= 10 THEN 'success' WHEN n >= 10 THEN 'exhausted' ELSE 'retry' END AS state
  FROM (SELECT key, min(i) FILTER (ok) AS f, max(i) AS n FROM (SELECT key, ok, row_number() OVER (PARTITION BY key ORDER BY position) AS i FROM (SELECT 'u' || user_id AS key, event_id AS position, event_type = 'purchase' AS ok FROM events)) GROUP BY 1)"""


def _attempts(events):
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("position"), (F.col("event_type") == "purchase").alias("ok"))


@query(_RETRIES)
def t9_retry_states(spark, sf_dir):
    return T.retry_table(_attempts(table(spark, sf_dir, "events")))


@query(_RETRIES)
def t9_retry_stream(spark, sf_dir):
    """The same by state over a stream: the last state of each key."""
    stream = T.read_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    out = T.run_to_end(T.retry_states(_attempts(stream)), mode="update")
    told = spark.read.schema("key string, attempts int, state string, batch int").option("basePath", out).parquet(f"{out}/batch=*")
    return told.groupBy("key").agg(F.max_by(F.struct("attempts", "state"), "batch").alias("r")).select("key", "r.*")


@query("SELECT vec_id FROM vectors WHERE vec_id % 7 = 0", VECTORS)
def t10_gate(spark, sf_dir):
    return T.gate(vectors(spark, sf_dir).filter("vec_id % 7 = 0").select("vec_id"), 50)


@query("SELECT 'l' || user_id AS label, 's' || j AS job FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0), (VALUES (1), (4), (5)) AS v(j) WHERE j <> 4")
def t11_due_jobs(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    schedules = users.select(F.concat(F.lit("l"), F.col("user_id").cast("string")).alias("label"), F.when(F.col("user_id") % 3 == 0, "07:30:00").otherwise("08:00:00").alias("schedule_time"), F.lit('["s1", "s4", "s5"]').alias("jobs"), F.lit(1).alias("is_active"))
    running = spark.createDataFrame([("s4",)], "job string")
    return T.due_jobs(schedules, F.broadcast(running), "07:30")
