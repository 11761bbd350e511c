"""Extraction from HTML by rules, in built-in expressions; the patterns stay within what Java and RE2 share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOISE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<iframe[^>]*>.*?</iframe>|<!--.*?-->"


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def unescaped(text: Column) -> Column:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def plain_text(fragment: Column) -> Column:
    """Tags out, entities read, blanks made one."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(fragment, r"<[^>]*>", " ")), r"\s+", " "))


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, _NOISE, " ")


def headline(html: Column, css_class: str | None = None) -> Column:
    """h1 of a class, h1, h2 of class title, og:title: the first that has text."""
    chain = [r"(?is)<h1[^>]*>(.*?)</h1>", r'(?is)<h2[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</h2>', r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"']
    if css_class:
        chain.insert(0, rf'(?is)<h1[^>]*class="[^"]*{css_class}[^"]*"[^>]*>(.*?)</h1>')
    return F.coalesce(*(F.nullif(plain_text(F.regexp_extract(html, p, 1)), F.lit("")) for p in chain))


def _element(html: Column, start: Column | str) -> Column:
    """(text, closed) of what is inside the first element whose opening tag `start` (a pattern without groups) matches; null text if there is none.

    The page is split before each tag of the element's name, and the depth, a running sum of opening and closing tags, tells which closing tag is its own.
    """
    start = F.lit(start) if isinstance(start, str) else start
    # an opening tag is at least "<x"; where none matches, the name is no tag's and the rest is null
    name = F.lower(F.regexp_extract(F.regexp_substr(html, start), r"^<([A-Za-z][A-Za-z0-9]*)", 1))
    rest = F.get(F.split(html, start, 2), F.lit(1))
    # a blank first: what comes before the first of those tags is never one itself
    parts = F.split(F.concat(F.lit(" "), rest), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])")))

    def step(seen: Column, part: Column) -> Column:
        depth = seen["depth"] + F.when(seen["at"] == 0, 0).when(part.startswith("</"), -1).otherwise(1)
        return F.struct(depth.alias("depth"), (seen["at"] + 1).alias("at"), F.when((seen["end"] < 0) & (depth == 0), seen["at"]).otherwise(seen["end"]).alias("end"))

    end = F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end")), step)["end"]
    whole = F.when(end < 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(end, F.lit(0))))
    return F.struct(F.substring(F.array_join(whole, ""), 2, 1 << 30).alias("text"), (end >= 0).alias("closed"))


def inside(html: Column, start: Column | str) -> Column:
    """What is inside the first element whose opening tag the pattern matches, up to its own closing tag, elements of its kind within it included; all the rest if it isn't closed, null if there is none."""
    return _element(html, start)["text"]


def every_inside(html: Column, start: Column | str) -> Column:
    """The same of all such elements in order, those within others as well."""
    begun = F.concat(F.lit("(?=") , F.lit(start) if isinstance(start, str) else start, F.lit(")"))
    parts = F.split(F.concat(F.lit(" "), html), begun)
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(part: Column, k: Column) -> Column:
        own = _element(part, start)
        return F.when(own["closed"], own["text"]).otherwise(inside(F.array_join(F.slice(after, k + 1, F.size(after) - k), ""), start))

    return F.transform(after, one)


def paragraph_texts(inside_of: Column, least: Column | int = 1) -> Column:
    found = F.transform(F.regexp_extract_all(inside_of, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain_text)
    return F.filter(found, lambda p: (p != "") & (F.length(p) >= least))


def paragraphs(html: Column, containers: Sequence[str] = (r"(?i)<article\b[^>]*>",), least: int = 0) -> Column:
    """Texts of the paragraphs, at least so long, in the first container (its opening tag's pattern) that is there and not empty, else in all of the page."""
    clean = without_noise(html)
    return paragraph_texts(F.coalesce(*(F.nullif(F.trim(inside(clean, c)), F.lit("")) for c in containers), clean), least)


def body(html: Column, least: int = 0, joint: str = " ", **given) -> Column:
    return F.array_join(paragraphs(html, least=least, **given), joint)


def first_paragraph(html: Column, over: int = 20) -> Column:
    return F.get(F.filter(paragraphs(html), lambda p: F.length(p) > over), F.lit(0))


def blocks(html: Column, pattern: str, joint: str = "\n") -> Column:
    """All matches of a pattern with one group, as texts, joined."""
    return F.array_join(F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), plain_text), lambda x: x != ""), joint)


def json_ld_nodes(html: Column) -> Column:
    """The nodes of all JSON-LD scripts, in order, as variants: a script's object, the elements of its array, and after each the nodes of its @graph. A script that is no JSON has none."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    parsed = F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())
    top = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.flatten(F.transform(top, lambda v: F.concat(F.array(v), listed(v, "$['@graph']"))))


def json_ld(html: Column, *fields: str) -> Column:
    """The first value, as text, of a field in any node of the page's JSON-LD; of several fields (paths, as image.url) the first that a node has. Objects and arrays are no values."""
    value = lambda v: F.coalesce(*(F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, f"$.{f}", "string")) for f in fields))
    return F.get(F.filter(F.transform(json_ld_nodes(html), value), lambda x: x.isNotNull()), F.lit(0))


def lead_image(html: Column) -> Column:
    """og:image, JSON-LD, an image of the article (late-loaded first), any image."""
    article = inside(html, r"(?i)<article\b[^>]*>")
    late, plain = r'(?is)<img\b[^>]*\bdata-src="([^"]*)"', r'(?is)<img\b[^>]*\ssrc="([^"]*)"'
    return F.coalesce(_found(html, r'(?is)<meta[^>]*property="og:image"[^>]*content="([^"]*)"'), json_ld(html, "image.url", "image[0].url", "image[0]", "image"), _found(article, late), _found(article, plain), _found(html, plain))


def tag_list(html: Column) -> Column:
    """Distinct tags in order: of the meta elements, else of the links with rel tag."""
    metas = F.regexp_extract_all(html, F.lit(r'(?is)<meta[^>]*property="article:tag"[^>]*content="([^"]*)"'), F.lit(1))
    links = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]*rel="tag"[^>]*>(.*?)</a>'), F.lit(1)), plain_text)
    return F.array_distinct(F.filter(F.when(F.size(metas) > 0, metas).otherwise(links), lambda x: x != ""))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, position, href) of each page, the first of equal ones."""
    hrefs = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.posexplode(hrefs).alias("position", "href"))


def site_of(source: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The first rule whose part the source contains."""
    found = F.lit(None).cast("string")
    for part, name in reversed(rules):
        found = F.when(F.lower(source).contains(part), name).otherwise(found)
    return found


def extract(pages: DataFrame, rules: DataFrame, html: str = "html", source: str = "url") -> DataFrame:
    """Each field of each page by the first rule that finds something. rules: site (null: all), field, priority, pattern (one group), min_len.

    The rules are a table of known size and are broadcast.
    """
    from pyspark.sql import Window

    matched = pages.join(F.broadcast(rules), rules["site"].isNull() | F.col(source).contains(rules["site"]))
    found = matched.select("page_id", "field", "priority", plain_text(F.expr(f"regexp_extract({html}, pattern, 1)")).alias("value"), "min_len").filter("length(value) >= greatest(1, min_len)")
    first = F.row_number().over(Window.partitionBy("page_id", "field").orderBy("priority"))
    return found.withColumn("r", first).filter("r = 1").select("page_id", "field", "value")
