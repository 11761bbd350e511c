"""Queries of scalar functions (F) and of HTML extraction (H)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..sources.sites import BODIES, HEADLINES, SITES, extract_articles
from .registry import query
from .views import ARTICLES, CATEGORIES, RUNS, articles, categories, runs, table

def _ts():
    return F.col("published_at")



def _bengali(text):
    return F.translate(text, "0123456789", D.DIGITS)


def _month(names):
    return F.element_at(F.array(*(F.lit(n) for n in names)), F.month(_ts()))


def _written(form: str):
    """A publication time as a site writes it."""
    day = F.concat_ws(" ", F.date_format(_ts(), "dd"), _month(D.MONTHS), F.date_format(_ts(), "yyyy"))
    half = F.when(F.hour(_ts()) >= 12, "পিএম").otherwise("এএম")
    other_half = F.when(F.hour(_ts()) >= 12, "অপরাহ্ন").otherwise("পূর্বাহ্ন")
    twelve, full = F.date_format(_ts(), "hh:mm"), F.date_format(_ts(), "HH:mm")
    weekday = F.element_at(F.array(*(F.lit(w) for w in D.WEEKDAYS)), F.dayofweek(_ts()) % 7 + 1)
    return {
        "f3": _bengali(F.concat(F.lit("প্রকাশ: "), day, F.lit(", "), twelve, F.lit(" "), half)),
        "f4": _bengali(F.concat(day, F.lit(", "), full)),
        "f5": _bengali(F.when(F.col("id") % 2 == 0, F.concat(day, F.lit(", "), twelve, F.lit(" "), other_half)).otherwise(F.concat(day, F.lit(", "), full))),
        "f6": _bengali(F.concat(F.lit("প্রকাশিত: "), day, F.lit(", "), twelve, F.lit(" "), half)),
        "f7": _bengali(F.concat(twelve, F.lit(" "), half, F.lit(", "), day)),
        "f8": _bengali(F.concat(F.lit("প্রকাশ: "), day, F.lit(" | "), full)),
        "f9": _bengali(F.when(F.col("id") % 2 == 0, F.concat(full, F.lit(", "), day)).otherwise(F.concat(day, F.lit(", "), full))),
        "f10": _bengali(F.concat(weekday, F.lit(", "), day)),
        "f11": _bengali(F.concat(weekday, F.lit(", "), day, F.lit(", "), twelve, F.lit(" "), half)),
        "f12": F.concat(F.lit("Publish : "), F.date_format(_ts(), "dd"), F.lit(" "), F.initcap(F.substring(_month(D.ENGLISH_MONTHS), 1, 3)), F.date_format(_ts(), " yyyy, hh:mm a"), F.lit(" Update : later")),
        "f13": F.concat(F.date_format(_ts(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+06:00")),
        "f14": F.date_format(_ts(), "yyyy-MM-dd HH:mm:ss"),
    }[form]


_DIALECTS = {
    "f3": ("marked", D.date_first_marked, "published_at"),
    "f4": ("full_day", D.date_first, "published_at"),
    "f5": ("auto", D.date_first, "published_at"),
    "f6": ("prefixed", lambda t: D.date_first(t, True), "published_at"),
    "f7": ("either_first", D.either_first, "published_at"),
    "f8": ("piped", D.piped, "published_at"),
    "f9": ("any_of_three", D.any_of_three, "published_at"),
    "f10": ("date_only", D.date_only, "date_trunc('day', published_at)"),
    "f11": ("local_to_utc", D.local_to_utc, "published_at - INTERVAL 6 HOURS"),
    "f12": ("english", D.english, "published_at"),
    "f13": ("iso_local", D.iso_local, "published_at"),
    "f14": ("meta", D.meta_time, "published_at"),
}


def _spoilt(text):
    """Four of nine rows have no valid date: no digits, nothing, null, no year."""
    kind = F.col("id") % 9
    return F.when(kind == 0, F.regexp_replace(text, "[0-9০-৯]", "")).when(kind == 1, "").when(kind == 3, F.regexp_replace(text, "[0-9০-৯]{4}", "")).when(kind != 2, text)


def _dialect(form, name, parse):
    def run(spark, sf_dir):
        texts = articles(spark, sf_dir).select("id", _spoilt(_written(form)).alias("raw"))  # a column of its own: the parsers ask for it many times
        return texts.select("id", parse(F.col("raw")).alias("parsed"))

    run.__name__ = f"{form}_{name}_date"
    return run


for _form, (_name, _parse, _sql) in _DIALECTS.items():
    query(f"SELECT id, CASE WHEN id % 9 > 3 THEN ({_sql})::TIMESTAMP END AS parsed FROM articles", ARTICLES)(_dialect(_form, _name, _parse))


@query("SELECT id, 37 * id AS n, month(published_at)::INTEGER AS m FROM articles", ARTICLES)
def f1_f2_digits_months(spark, sf_dir):
    return articles(spark, sf_dir).select("id", D.ascii_digits(_bengali((F.col("id") * 37).cast("string"))).cast("long").alias("n"), D.month_number(_month(D.MONTHS)).alias("m"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE published_at END AS parsed FROM articles", ARTICLES)
def f15_first_valid_date(spark, sf_dir):
    i = F.col("id")
    meta = F.when(i % 4 == 1, _written("f14")).otherwise("soon")
    script = F.when(i % 4 == 2, F.concat(F.lit('<script type="application/ld+json">{"broken": </script><script type="application/ld+json">[{"x": 1}, {"@graph": [' + '{"a": 1}, ' * 11 + '{"datePublished": "'), _written("f13"), F.lit('"}]}]</script>'))).otherwise("")
    text = F.when(i % 4 == 3, _written("f3")).otherwise("")
    return articles(spark, sf_dir).select("id", D.first_valid(D.meta_time(meta), D.iso_local(H.json_ld(script, "datePublished")), D.date_first_marked(text)).alias("parsed"))


@query("SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS v FROM articles", ARTICLES)
def f16_normalized(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.normalized(F.col("content")).alias("v"))


#: Headlines with marks behind them: all kinds, a dollar sign among others, a blank before or after.
_MARKED = "headline || ['!?', '।', '$.', ' !', '. ', ')\"', ':–', ''][id % 8 + 1]"


def _marked():
    tail = F.element_at(F.array(*(F.lit(t) for t in ("!?", "।", "$.", " !", ". ", ')"', ":–", ""))), (F.col("id") % 8 + 1).cast("int"))
    return F.concat("headline", tail)


@query(f"SELECT id, rtrim({_MARKED}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~।') AS v, rtrim({_MARKED}, '!\"#%&''()*+,-./:;<=>?@[\\]^_`{{|}}~।') AS kept_dollar FROM articles", ARTICLES)
def f17_trailing_marks(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.without_trailing_marks(_marked()).alias("v"), X.without_trailing_marks(_marked(), X.TRAILING_MARKS_NO_DOLLAR).alias("kept_dollar"))


@query(f"SELECT id, regexp_replace(rtrim({_MARKED}, '।!?.,:;''\"'), '^\\s+|\\s+$', '', 'g') AS v FROM articles", ARTICLES)
def f17_few_trailing_marks(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.without_trailing_marks(_marked(), X.FEW_TRAILING_MARKS, True).alias("v"))


@query("SELECT id, array_to_string(w[1:len(w) - 1], ' ') AS v FROM (SELECT id, string_split_regex(regexp_replace(regexp_replace(headline, '^ +', ''), ' +$', ''), '\\s+') AS w FROM articles)", ARTICLES)
def f18_without_last_word(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.without_last_word(F.col("headline")).alias("v"))


@query("SELECT id, regexp_replace(replace(content, '.', chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS v FROM articles", ARTICLES)
def f19_newlines(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.collapsed_newlines(F.replace("content", F.lit("."), F.lit("\n\n"))).alias("v"))


@query("SELECT id, CASE WHEN length(headline) > 100 THEN left(headline, 100) || '...' ELSE headline END AS name, CASE WHEN length(headline) > 50 THEN left(headline, 47) || '...' ELSE headline END AS shown FROM articles", ARTICLES)
def f20_truncated(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.truncated(F.col("headline"), 100).alias("name"), X.truncated(F.col("headline"), 47, 50).alias("shown"))


@query("SELECT id, sha256(trim(coalesce(nullif(headline, ''), actual_headline, '') || chr(10) || chr(10) || left(content, 500))) AS hash FROM articles", ARTICLES)
def f21_f22_text_hash(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.text_hash(X.embedding_text(F.col("headline"), F.col("actual_headline"), F.col("content"))).alias("hash"))


@query("SELECT id, CASE WHEN source_site = 'src3' THEN NULL ELSE source_url END AS v, id::VARCHAR AS item, id::VARCHAR AS slug, 6::BIGINT AS n, id || '' AS base FROM (SELECT *, 1 AS x FROM articles)", ARTICLES)
def f23_f28_urls(spark, sf_dir):
    i, u = F.col("id"), F.col("source_url")
    written = F.when(F.col("source_site") == "src3", F.concat(F.lit("https://other.org/"), i.cast("string"))).when(i % 3 == 0, F.concat(u, F.lit("/?page=2#top"))).otherwise(F.concat(u, F.lit("?x=1")))
    canonical = U.canonical_url(written, "https://example", "example", numeric_end=True)
    return articles(spark, sf_dir).select("id", canonical.alias("v"), U.item_id(u).alias("item"), U.slug(u).alias("slug"), (F.size(U.path_segments(u)) + 1).cast("long").alias("n"), U.basename(F.concat(u, F.lit("?q=1"))).alias("base"))


@query("SELECT id, 'https://cdn.example/img/' || id || '.jpg' AS cleaned, 'https://cdn.example/i?h=2&q=70&w=' || id AS keyed FROM articles", ARTICLES)
def f27_image_urls(spark, sf_dir):
    i = F.col("id").cast("string")
    og = F.concat(F.lit("https://cdn.example/og/img/"), i, F.lit("-fb.jpg?watermark=1"))
    keyed = F.concat(F.lit("https://cdn.example/i?w="), i, F.lit("&auto=1&h=2"))
    return articles(spark, sf_dir).select("id", U.clean_image_url(og).alias("cleaned"), U.without_query_keys(keyed, ["auto"], {"q": "70", "w": "100"}).alias("keyed"))


#: Labels of sections in the forms that three kinds of sites write: by position, with a known division second, with one anywhere behind a marker.
_LABEL_SQL = "label AS (SELECT id, ['one-country-news', 'two', 'three-country-x', 'three-world'][id % 4 + 1] || ['-dhaka', '-Sylhet', '-khulna', '-nowhere', ''][id % 5 + 1] || ['-gazipur', ''][id % 2 + 1] || ['', '-a', '-a-b'][id % 3 + 1] AS l FROM articles)"


def _labels(spark, sf_dir):
    pick = lambda *texts: F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("id") % len(texts) + 1).cast("int"))
    label = F.concat(pick("one-country-news", "two", "three-country-x", "three-world"), pick("-dhaka", "-Sylhet", "-khulna", "-nowhere", ""), pick("-gazipur", ""), pick("", "-a", "-a-b"))
    return articles(spark, sf_dir).select("id", label.alias("l"))


def _place(found):
    return [found[c].alias(c) for c in ("division", "district", "upazilla")]


_DIVISION_LIST = "['dhaka', 'chittagong', 'sylhet', 'rajshahi', 'khulna', 'barisal', 'rangpur', 'mymensingh']"


@query("SELECT id, CASE WHEN ok THEN p[4] END AS division, CASE WHEN ok THEN p[5] END AS district, CASE WHEN ok THEN p[6] END AS upazilla FROM (SELECT id, p, starts_with(l, 'one-country-news') AND len(p) >= 5 AS ok FROM (SELECT id, l, string_split(l, '-') AS p FROM label))", ARTICLES, _LABEL_SQL)
def f29_location_by_position(spark, sf_dir):
    return _labels(spark, sf_dir).select("id", *_place(U.location_fixed(F.col("l"), "one-country-news")))


@query(f"SELECT id, CASE WHEN ok THEN p[2] END AS division, CASE WHEN ok THEN p[3] END AS district, CASE WHEN ok AND len(p) > 3 THEN array_to_string(p[4:], '-') END AS upazilla FROM (SELECT id, p, len(p) >= 3 AND list_contains({_DIVISION_LIST}, p[2]) AS ok FROM (SELECT id, string_split(l, '-') AS p FROM label))", ARTICLES, _LABEL_SQL)
def f29_location_known_division(spark, sf_dir):
    return _labels(spark, sf_dir).select("id", *_place(U.location_known(F.col("l"))))


@query(f"""SELECT id, p[i] AS division, coalesce(p[i + 1], p[i]) AS district, CASE WHEN p[i + 2] <> '' THEN array_to_string(p[i + 2:], '-') END AS upazilla
  FROM (SELECT id, p, CASE WHEN contains(lower(l), 'country') THEN list_min(list_filter(range(1, len(p) + 1), lambda i: list_contains({_DIVISION_LIST}, p[i]))) END AS i FROM (SELECT id, l, string_split(lower(l), '-') AS p FROM label))""", ARTICLES, _LABEL_SQL)
def f29_location_scan(spark, sf_dir):
    return _labels(spark, sf_dir).select("id", *_place(U.location_scan(F.col("l"))))


@query("SELECT id, len(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS n, len(list_filter(list_transform(string_split_regex(content, '\\n+'), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS p FROM articles", ARTICLES)
def f30_f31_tags_paragraphs(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.size(X.tags(F.col("tags"))).alias("n"), F.size(X.paragraphs(F.col("content"))).alias("p"))


@query("""SELECT id, CASE WHEN id % 4 = 3 THEN ['Root', 'Main Category', 'Sub-Category', 'Sub-Sub Category', 'Deep Category', 'Deep Category'][id % 6 + 1]
  ELSE ['Main Category', 'Division', 'District', 'Upazilla', 'Area', 'Area'][id % 6 + 1] END AS level FROM categories""", CATEGORIES)
def f32_level(spark, sf_dir):
    """Paths of up to five segments below the marker, and without it labels of as many parts."""
    i = F.col("id")
    deep = F.concat(U.path_segments(F.col("category_url")), F.array(F.lit("x"), F.lit("y")))
    path = F.when(i % 4 == 3, F.array(F.lit("world"), F.lit("news"))).otherwise(F.slice(deep, F.lit(1), (i % 6 + 1).cast("int")))
    label = F.array_join(F.array_repeat(F.lit("part"), (i % 6 + 1).cast("int")), "-")
    return categories(spark, sf_dir).select("id", U.level_label(path, label).alias("level"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END
  ELSE (s // 3600) || 'h' || CASE WHEN s % 3600 >= 60 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END END AS v FROM (SELECT event_id, (event_id * 10)::BIGINT AS s FROM runs)""", RUNS)
def f33_duration(spark, sf_dir):
    return runs(spark, sf_dir).select("event_id", X.duration(F.col("event_id") * 10).alias("v"))


@query("SELECT id, dayname(published_at) AS weekday, date_diff('day', DATE '2024-01-01', published_at::DATE)::INTEGER + 1 AS days FROM articles", ARTICLES)
def f34_weekday(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.date_format("published_at", "EEEE").alias("weekday"), (F.datediff("published_at", F.lit("2024-01-01").cast("date")) + 1).alias("days"))


@query("""SELECT event_id, CASE WHEN line LIKE '[STATUS:finding:%' THEN 'finding' WHEN line LIKE '[STATUS:extracting:%' THEN 'extracting' END AS state, nullif(regexp_extract(line, 'PROGRESS ([0-9]+) ([0-9]+)', 2), '')::INTEGER AS n,
  line LIKE '✓ Inserted%' AS inserted, line LIKE '%Updated existing article%' AS updated, line LIKE '✓ SUCCESS%' AS success, line LIKE 'Error%' OR line LIKE '✗%' AS error,
  CASE WHEN line LIKE '✓ SUCCESS%' THEN 2 WHEN line LIKE '✓ Inserted%' OR line LIKE '[OK] Updated%' THEN 1 ELSE 0 END::INTEGER AS processed FROM runs""", RUNS)
def f35_f36_log_lines(spark, sf_dir):
    flags = X.log_flags(F.col("line"))
    told = [flags[c].alias(c) for c in ("inserted", "updated", "success", "error", "processed")]
    return runs(spark, sf_dir).select("event_id", X.status_state(F.col("line")).alias("state"), X.progress(F.col("line"))["n"].alias("n"), *told)


@query("SELECT event_id, (props->>'k')::INTEGER AS k FROM events")
def f37_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_id, CASE WHEN CASE WHEN mark IS NULL THEN ts::DATE = until::DATE ELSE ts > mark AND ts <= until END THEN ts
    WHEN CASE WHEN mark IS NULL THEN modified::DATE = until::DATE ELSE modified > mark AND modified <= until END THEN modified END AS t
  FROM (SELECT event_id, ts, ts + INTERVAL 1 DAY AS modified, ts + to_hours([NULL, -1, 1, 48][event_id % 4 + 1]) AS mark, ts + to_hours([36, 2, 30, 60][event_id % 4 + 1]) AS until FROM events)""")
def f40_effective_time(spark, sf_dir):
    pick = lambda *values: F.element_at(F.array(*(F.lit(v).cast("int") for v in values)), (F.col("event_id") % 4 + 1).cast("int"))
    after = lambda hours: F.col("ts") + F.make_dt_interval(F.lit(0), hours)
    return table(spark, sf_dir, "events").select("event_id", D.effective_time(F.col("ts"), after(F.lit(24)), after(pick(None, -1, 1, 48)), after(pick(36, 2, 30, 60))).alias("t"))


def _sql_text(x):
    inner = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        inner = f"replace({inner}, '{name}', '{mark}')"
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"


_CLEAN = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<iframe[^>]*>.*?</iframe>|<!--.*?-->', ' ', 'g')"
_PARAGRAPHS = f"""paragraphs AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(coalesce(nullif(trim(regexp_extract(c, '(?is)<article[^>]*>(.*?)</article>', 1)), ''), c), '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {_sql_text("x")}), lambda x: x <> '') AS p FROM (SELECT page_id, {_CLEAN} AS c FROM pages))"""


@query(f"SELECT page_id, nullif({_sql_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '') AS headline FROM pages")
def h1_headline(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.headline(F.col("html"), "story-title").alias("headline"))


@query("SELECT page_id, array_to_string(list_filter(p, lambda x: length(x) >= 20), ' ') AS body FROM paragraphs", _PARAGRAPHS)
def h2_body(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.body(F.col("html"), 20).alias("body"))


@query("SELECT page_id, list_filter(p, lambda x: length(x) > 20)[1] AS first FROM paragraphs", _PARAGRAPHS)
def h3_first_paragraph(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.first_paragraph(F.col("html")).alias("first"))


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: {_sql_text('x')}), lambda x: x <> ''), chr(10)) AS items FROM pages")
def h4_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.blocks(F.col("html"), r"(?is)<li[^>]*>(.*?)</li>").alias("items"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'og' WHEN 1 THEN 'ld' WHEN 2 THEN 'late' ELSE 'plain' END || page_id || '.jpg' AS image FROM pages")
def h5_lead_image(spark, sf_dir):
    name = lambda kind: F.concat(F.lit(kind), F.col("page_id").cast("string"), F.lit(".jpg"))
    wrap = lambda a, kind, b: F.concat(F.lit(a), name(kind), F.lit(b), F.col("html"))
    k = F.col("page_id") % 4
    page = F.when(k == 0, wrap('<meta property="og:image" content="', "og", '">')).when(k == 1, wrap('<script type="application/ld+json">[{}, {}, {}, {"@graph": [{"image": {"alt": "x"}}, {"image": {"url": "', "ld", '"}}]}]</script>')).when(k == 2, wrap('<article><img class="x" data-src="', "late", '" src="y.gif"></article>')).otherwise(wrap('<p><img src="', "plain", '"></p>'))
    return table(spark, sf_dir, "pages").select("page_id", H.lead_image(page).alias("image"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a, b' || page_id ELSE 'c, d' END AS tags FROM pages")
def h6_tags(spark, sf_dir):
    meta = F.concat(F.lit('<meta property="article:tag" content="a"><meta property="article:tag" content="b'), F.col("page_id").cast("string"), F.lit('"><meta property="article:tag" content="a">'))
    page = F.concat(F.when(F.col("page_id") % 2 == 0, meta).otherwise(""), F.lit('<a href="/c" rel="tag"><b>c</b></a> <a rel="tag" href="/d">d</a>'), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(H.tag_list(page), ", ").alias("tags"))


@query("SELECT page_id, 'by ' || page_id AS author FROM pages")
def h7_json_ld(spark, sf_dir):
    field = F.concat(F.lit('"author": "by '), F.col("page_id").cast("string"), F.lit('"'))
    k = F.col("page_id") % 3
    within = lambda a, b: F.concat(F.lit(a), field, F.lit(b))
    ld = F.when(k == 0, within("{", "}")).when(k == 1, within('[{"x": 1}, {"x": 1}, {"x": 1}, {"x": 1}, {', "}]")).otherwise(within('{"@graph": [' + '{"author": {"name": "x"}}, ' * 12 + "{", "}]}"))
    page = F.concat(F.lit('<script type="application/ld+json">not json</script><script type="application/ld+json">'), ld, F.lit("</script>"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", H.json_ld(page, "author").alias("author"))


@query("SELECT page_id, h AS href, min(i) - 1 AS position_in_all FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)) GROUP BY ALL")
def h8_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    every = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("i", "href")).groupBy("page_id", "href").agg(F.min("i").cast("long").alias("position_in_all"))
    return H.links(pages).join(every, ["page_id", "href"]).select("page_id", "href", "position_in_all")


@query("SELECT page_id, array_to_string(p, chr(10) || chr(10)) AS text FROM paragraphs", _PARAGRAPHS)
def h9_fragment_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.body(F.col("html"), joint="\n\n").alias("text"))


_NAMES = [part for part, _ in SITES]
_SITE_LIST = ", ".join(f"'{part}'" for part in _NAMES)
#: The page's paragraphs of more than 30 characters, in its article.
_LONG = "array_to_string(list_filter(p, lambda x: length(x) >= 31), ' ')"


@query(f"""SELECT page_id, CASE WHEN n = 'bd-pratidin' THEN 'bdpratidin' ELSE n END AS site, CASE n WHEN 'desh' THEN NULL WHEN 'kalbela' THEN rtrim(h, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~।') ELSE h END AS headline,
  CASE WHEN n IN ('sangbad', 'amadershomoy', 'bdpratidin', 'bd-pratidin', 'mzamin', 'dhakatribune', 'janakantha') THEN nullif({_LONG}, '') END AS content
  FROM (SELECT page_id, [{_SITE_LIST}][page_id % {len(_NAMES)} + 1] AS n, p, {_sql_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h FROM paragraphs JOIN pages USING (page_id))""", _PARAGRAPHS)
def h10_site_rules(spark, sf_dir):
    """The pages as if of all the known sites in turn, by the rules of each."""
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    return extract_articles(table(spark, sf_dir, "pages").withColumn("source_site", F.concat(F.lit("the "), name))).select("page_id", "site", "headline", "content")


def _tag_of(selector: str) -> str:
    """An opening tag that the selector of an element finds."""
    tag, kind, name = re.fullmatch(r"([\w*]+)(?:([.#~])(.+))?", selector).groups()
    attribute = {None: "", "#": f' id="{name}"'}.get(kind, f' class="{name} other"')
    return f"<{'section' if tag == '*' else tag}{attribute}>"


#: Before the first container there is an element that is none, and within it others of its own kind that close before its paragraphs begin; after it comes a paragraph that isn't in it.
_MENU = '<div class="menu"><p>The menu of the site, a rather long line of words in it.</p></div>'
_ASIDE, _AFTER = "<{0} class=\"aside\"><{0}>x</{0}></{0}>", "<p>Words after the end of the container, which don't belong to it at all.</p>"
_OPEN = {site: _tag_of(BODIES[site][0].split()[0].replace("page", "article")) for site in HEADLINES}
_HEAD = {site: _tag_of(HEADLINES[site].split()[0]) for site in HEADLINES}


def _nested(site: str) -> tuple[str, str]:
    """What stands before and after the paragraphs on a page of the site."""
    kind, head = re.match(r"<(\w+)", _OPEN[site])[1], re.match(r"<(\w+)", _HEAD[site])[1]
    before = f"{_HEAD[site]}<span>Head</span> line</{head}>{_MENU}{_OPEN[site]}" + _ASIDE.format(kind)
    return before, f"</{kind}>{_AFTER}"


_TAKEN = ", ".join(f"('{site}', '{taken}', {least}, '{_nested(site)[0].split(_OPEN[site])[1]}', {'page' in containers})" for site, (containers, taken, least) in BODIES.items())
#: The paragraphs' page, for the sites that take those of the whole page if the containers have none.
_PAGE = "'" + _MENU + "' || {} || '" + _AFTER.replace("'", "''") + "'"
_LINES = "regexp_replace(regexp_replace(regexp_replace((aside || own), '<[^>]*>', chr(10), 'g'), '[ \\t\\r\\f]*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT page_id, site, 'Head line' AS headline, nullif(CASE taken WHEN 'first' THEN list_filter(p, lambda x: length(x) >= least)[1] WHEN 'text' THEN {_sql_text("(aside || own)")} WHEN 'each' THEN {_sql_text("(aside || own)")} WHEN 'lines' THEN {_LINES}
    ELSE coalesce(nullif(array_to_string(list_filter(p, lambda x: length(x) >= least), ' '), ''), CASE WHEN page THEN array_to_string(list_filter(list_transform(regexp_extract_all({_PAGE.format("own")}, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_sql_text("x")}), lambda x: length(x) >= least), ' ') END) END, '') AS content
  FROM (SELECT page_id, own, list_filter(list_transform(regexp_extract_all(own, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_sql_text("x")}), lambda x: x <> '') AS p,
    [{", ".join(f"'{s}'" for s in HEADLINES)}][page_id % {len(HEADLINES)} + 1] AS site FROM (SELECT page_id, regexp_replace(regexp_extract({_CLEAN}, '(?is)<article[^>]*>(.*?)</article>', 1), '&[a-z#0-9]*;', '', 'g') AS own FROM pages)) JOIN (VALUES {_TAKEN}) AS t(site, taken, least, aside, page) USING (site)""")
def h10_nested_pages(spark, sf_dir):
    """The pages' paragraphs in the markup of each known site, in containers that have elements of their own kind within them."""
    names = list(HEADLINES)
    k = (F.col("page_id") % len(names) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), k)
    inner = F.regexp_replace(F.regexp_extract(H.without_noise(F.col("html")), r"(?is)<article[^>]*>(.*?)</article>", 1), "&[a-z#0-9]*;", "")
    page = F.concat(pick([_nested(s)[0] for s in names]), inner, pick([_nested(s)[1] for s in names]))
    return extract_articles(table(spark, sf_dir, "pages").select("page_id", pick(names).alias("source_site"), page.alias("html"))).select("page_id", "site", "headline", "content")


@query("SELECT doc_id, CASE WHEN source LIKE '%src1%' THEN 'one' WHEN source LIKE '%src2%' THEN 'two' WHEN source LIKE '%src%' THEN 'rest' END AS site FROM documents")
def h10_site(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.site_of(F.col("source"), [("src1", "one"), ("src2", "two"), ("src", "rest")]).alias("site"))


@query(f"SELECT page_id, 'title' AS field, {_sql_text("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS value FROM pages UNION ALL SELECT page_id, 'lang', regexp_extract(html, 'lang=\"([a-z]+)\"', 1) FROM pages")
def h0_rule_table(spark, sf_dir):
    rules = spark.createDataFrame([(None, "title", 1, r"(?is)<title>(.*?)</title>", 1), (None, "lang", 2, r'(?is)<html[^>]*lang="([a-z]+)"', 1), ("nowhere", "title", 0, "(nothing)", 1)], "site string, field string, priority int, pattern string, min_len int")
    return H.extract(table(spark, sf_dir, "pages"), rules)
