"""Where the pages of known sites have headline, body and lead image, as tables of selectors; the expressions are built from them.

A selector is tag.class, tag#id, tag?attribute, tag (any of its elements) or property:name of a meta element; `~` for `.` lets the class be a part of a class name; `*` as a tag is any
element, `page` the whole page. An element ends at its own closing tag.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import every_inside, inside, paragraph_texts, plain_text, site_of, unescaped, without_noise
from ..functions.text import without_trailing_marks
from ..functions.urls import basename

#: What a source's name contains, in the order of asking, and whose rules it has.
SITES = (
    ("kalbela", "kalbela"),
    ("desh", "desh"),
    ("jugantor", "jugantor"),
    ("ittefaq", "ittefaq"),
    ("bdnews24", "bdnews24"),
    ("prothomalo", "prothomalo"),
    ("dhakapost", "dhakapost"),
    ("jagonews24", "jagonews24"),
    ("samakal", "samakal"),
    ("sangbad", "sangbad"),
    ("amadershomoy", "amadershomoy"),
    ("bdpratidin", "bdpratidin"),
    ("bd-pratidin", "bdpratidin"),
    ("mzamin", "mzamin"),
    ("dhakatribune", "dhakatribune"),
    ("janakantha", "janakantha"),
    ("boishakhi", "boishakhi"),
)

#: Of each site the selectors of the headline, the first that has text.
HEADLINES = {
    "kalbela": "h1.details-title h1",
    "desh": "*.details-title",
    "jugantor": "h1.my-3 h1",
    "ittefaq": "h1.title h1",
    "bdnews24": "h1",
    "prothomalo": "h1",
    "dhakapost": "h1",
    "jagonews24": "h1 h2",
    "samakal": "h1",
    "sangbad": "h1 h2.title",
    "amadershomoy": "h1 property:og:title",
    "bdpratidin": "h1.card-title h1",
    "mzamin": "h1 h2.title",
    "dhakatribune": "h1.title h1",
    "janakantha": "h1",
    "boishakhi": "h1",
}

#: Of each site the containers of the body, the first that has text; what is taken (first paragraph, all paragraphs, those of the first container that has any, whole text, its lines,
#: every such element); and the characters that a paragraph has at least.
BODIES = {
    "kalbela": ("div.dtl_content_section div.dtl-class div.body-content", "first", 21),
    "desh": ("*.dtl_content_section", "text", 1),
    "jugantor": ("div.desktopDetailBody", "lines", 1),
    "ittefaq": ("div.content_detail_each_group", "paragraphs", 1),
    "bdnews24": ("div#contentDetails div.details-brief div.article-content div.custombody div.content div.story-content", "paragraphs", 1),
    "prothomalo": ("div~story-element-text", "each", 1),
    "dhakapost": ("div~news-details", "paragraphs", 1),
    "jagonews24": ("div.content-details", "paragraphs", 1),
    "samakal": ("div#contentDetails div.dNewsDesc div.article-content div.article-body", "paragraphs", 21),
    "sangbad": ("div.article-content div.content article page", "paragraphs", 31),
    "amadershomoy": ("article page", "paragraphs", 31),
    "bdpratidin": ("article", "paragraphs", 31),
    "mzamin": ("div.article-content article div.content", "only", 31),
    "dhakatribune": ("article.jw_detail_content_holder div.content_detail_each_group article", "paragraphs", 31),
    "janakantha": ("article.DDetailsContent article", "paragraphs", 31),
    "boishakhi": ("div.dtl_content_section", "paragraphs", 31),
}

#: Of each site where the lead image's address is: an element, or an element within another (>), the attribute that goes before src (@), and what the
#: address has in it (=, & between several).
IMAGES = {
    "kalbela": "img.detailImg",
    "desh": "img.detailImg",
    "jugantor": "figure>img div.desktopDetailPhotoDiv>img",
    "ittefaq": "property:og:image",
    "bdnews24": "img.img-responsive",
    "prothomalo": "img",
    "dhakapost": "img~w-full=cdn.dhakapost.com/media/imgAll",
    "jagonews24": "property:og:image=cdn.jagonews24.com",
    "samakal": "div.DNewsImg>img@data-src img@data-src",
    "sangbad": "img?src=/images/&main_image property:og:image",
    "amadershomoy": "property:og:image img?src",
    "bdpratidin": "property:og:image",
    "mzamin": "property:og:image img.article-image img",
    "dhakatribune": "property:og:image",
    "janakantha": "img.TopImg property:og:image",
    "boishakhi": "div.dtl_img_section>img property:og:image",
}
#: Sites whose headlines lose the marks at their end.
TRIMMED_HEADLINES = ("kalbela",)
#: Sites whose images lose their query.
WITHOUT_QUERY = ("ittefaq",)


def opening(selector: str) -> str:
    """The pattern of an element's opening tag, without groups; of a meta element the one whose group is its content."""
    if selector.startswith("property:"):
        return rf'(?is)<meta[^>]*\sproperty="{re.escape(selector[9:])}"[^>]*\scontent="([^"]*)"'
    tag, kind, name = re.fullmatch(r"([\w*]+)(?:([.#~?])(.+))?", selector).groups()
    word = r"[a-zA-Z]\w*" if tag == "*" else tag
    value = re.escape(name or "").replace(r"\-", "-")
    attribute = {None: "", "?": rf"[^>]*\s{value}=", "#": rf'[^>]*\sid="{value}"', ".": rf'[^>]*\sclass="(?:[^"]*\s)?{value}(?:\s[^"]*)?"', "~": rf'[^>]*\sclass="[^"]*{value}[^"]*"'}[kind]
    return rf"(?is)<{word}\b{attribute}[^>]*>"


_RULE = "site string, headline array<string>, trimmed boolean, body array<string>, taken string, least int, image array<struct<outer: string, inner: string, late: string, parts: array<string>>>, without_query boolean"


def _image_rule(selector: str) -> tuple[str, str, str, list[str]]:
    selector, _, parts = selector.partition("=")
    if selector.startswith("property:"):
        return "", opening(selector), "", parts.split("&")
    outer, _, inner = selector.rpartition(">")
    inner, _, late = inner.partition("@")
    return opening(outer) if outer else "", opening(inner), late, parts.split("&")


def site_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table, a row a site."""
    rows = []
    for site, headlines in HEADLINES.items():
        containers, taken, least = BODIES[site]
        body = ["" if c == "page" else opening(c) for c in containers.split()]
        rows.append((site, [opening(h) for h in headlines.split()], site in TRIMMED_HEADLINES, body, taken, least, [_image_rule(i) for i in IMAGES[site].split()], site in WITHOUT_QUERY))
    return spark.createDataFrame(rows, _RULE)


def _first(rules: Column, find: Callable[[Column], Column]) -> Column:
    """What the first rule finds that finds something but an empty text."""
    return F.aggregate(rules, F.lit(None).cast("string"), lambda found, rule: F.coalesce(found, F.nullif(find(rule), F.lit(""))))


def _group(text: Column, pattern: Column) -> Column:
    """The first group of a pattern that is a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def _is_meta(start: Column) -> Column:
    return start.contains("<meta")


def _headline(html: Column) -> Column:
    found = _first(F.col("headline_rules"), lambda start: plain_text(F.when(_is_meta(start), _group(html, start)).otherwise(inside(html, start))))
    return F.when(F.col("trimmed"), without_trailing_marks(found)).otherwise(found)


def _body(clean: Column) -> Column:
    taken, least = F.col("taken"), F.col("least")

    def text_in(start: Column) -> Column:
        own = F.when(start == "", clean).otherwise(inside(clean, start))
        lines = F.regexp_replace(F.regexp_replace(unescaped(F.regexp_replace(own, r"<[^>]*>", "\n")), r"[ \t\r\f]*\n\s*", "\n"), r"^\s+|\s+$", "")
        each = F.array_join(F.filter(F.transform(every_inside(clean, start), plain_text), lambda x: x != ""), " ")
        long = paragraph_texts(own, least)
        found = F.when(taken == "text", plain_text(own)).when(taken == "lines", lines).when(taken == "each", each).when(taken == "first", F.get(long, F.lit(0))).otherwise(F.array_join(long, " "))
        decides = (taken == "only") & F.coalesce(own.rlike(r"(?i)<p\b[^>]*>"), F.lit(False))
        return F.when(decides & (found == ""), "\0").otherwise(found)  # nothing, and nothing further is asked

    return F.nullif(_first(F.col("body_rules"), text_in), F.lit("\0"))


def _image(html: Column) -> Column:
    def address(rule: Column) -> Column:
        within = F.when(rule["outer"] == "", html).otherwise(inside(html, rule["outer"]))
        tag = F.regexp_substr(within, rule["inner"])
        late = F.nullif(_group(within, F.concat(F.lit(r"(?is)<img\b[^>]*\s"), rule["late"], F.lit('="([^"]*)"'))), F.lit(""))
        own = F.nullif(F.regexp_extract(tag, r'(?is)\ssrc="([^"]*)"', 1), F.lit(""))
        found = F.when(_is_meta(rule["inner"]), _group(html, rule["inner"])).when(rule["late"] != "", F.coalesce(late, own)).otherwise(own)
        return F.when(F.forall(rule["parts"], found.contains), found)

    found = _first(F.col("image_rules"), address)
    return F.when(F.col("without_query"), basename(found, drop_query=True)).otherwise(basename(found, drop_query=False))


def extract_articles(pages: DataFrame, source: str = "source_site", html: str = "html") -> DataFrame:
    """pages with site (null: none known), headline, content and image_name by the rules of the site that the source names.

    The rules are rows, one for each known site, joined to the pages; one expression a field reads them, and scripts, styles and comments are taken out once a page.
    """
    named = pages.withColumn("site", site_of(F.col(source), SITES)).withColumn("__clean", without_noise(F.col(html)))
    rules = site_rules(pages.sparkSession).withColumnsRenamed({"headline": "headline_rules", "body": "body_rules", "image": "image_rules"})
    found = {"headline": _headline(F.col(html)), "content": _body(F.col("__clean")), "image_name": _image(F.col(html))}
    kept = [c for c in named.columns if c != "__clean" and c not in found]
    return named.select(*kept, "__clean").join(F.broadcast(rules), "site", "left").select(*kept, *(c.alias(name) for name, c in found.items()))
