"""Predicates and filters over article-like rows. Relative ranges take as_of; nothing asks the clock."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_AVAILABLE = "Not Available"
FAILED_HEADLINE = "Failed to scrape"
MOST_ATTEMPTS = 10
#: Words in the addresses of images that are no article image.
NO_IMAGE_WORDS = ("logo", "icon", "avatar", "sprite", "banner", "ad-", "advertisement")


def contains(column: Column, part: str) -> Column:
    """LIKE '%part%' as a case-insensitive collation has it."""
    return F.lower(column).contains(part.lower())


def on_days(column: Column, first: date, last: date) -> Column:
    """Whole days from first to last, as a range on the raw timestamp that a scan can use."""
    day = lambda d: F.lit(datetime(d.year, d.month, d.day).isoformat(" ")).cast("timestamp_ntz")
    return (column >= day(first)) & (column < day(last + timedelta(days=1)))


def report_days(preset: str, as_of: datetime, start: str | None = None, end: str | None = None) -> tuple[date, date]:
    """First and last day of a report: today, yesterday, week (7 days), month (30 days) or custom (YYYY-MM-DD; as_of by default)."""
    today = as_of.date()
    if preset == "custom":
        return day_or(start, today), day_or(end, today)
    return {"today": (today, today), "yesterday": (today - timedelta(1), today - timedelta(1)), "week": (today - timedelta(6), today), "month": (today - timedelta(29), today)}[preset]


def day_or(text: str | None, default: date) -> date:
    if not text:
        return default
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        raise ValueError(f"not a day as YYYY-MM-DD: {text!r}")
    return date.fromisoformat(text)


def listed_within(column: Column, preset: str, as_of: datetime) -> Column:
    """Presets of lists: today and yesterday by day, week and month as the last 7 or 30 times 24 hours."""
    if preset in ("today", "yesterday"):
        first, last = report_days(preset, as_of)
        return on_days(column, first, last)
    return column >= F.lit((as_of - timedelta(days={"week": 7, "month": 30}[preset])).isoformat(" ")).cast("timestamp_ntz")


def search(rows: DataFrame, source: str | None = None, preset: str | None = None, as_of: datetime | None = None, category: str | None = None, text: str | None = None, status: str | None = None) -> DataFrame:
    """Rows that meet every condition that is given."""
    conditions = [F.lit(True)]
    if source:
        conditions.append(contains(F.col("source_site"), source))
    if preset:
        conditions.append(listed_within(F.col("published_at"), preset, as_of))
    if category:
        conditions.append(F.col("category") == category)
    if text:
        conditions.append(contains(F.col("headline"), text) | contains(F.col("content"), text))
    if status:
        conditions.append(F.col("scraping_status") == status)
    return rows.filter(reduce(and_, conditions))


def like_newest(rows: DataFrame, patterns: Sequence[str], n: int = 10, column: str = "headline") -> DataFrame:
    """The n newest rows that are LIKE one of the patterns, whatever the case."""
    wanted = reduce(lambda a, b: a | b, [F.lower(column).like(p.lower()) for p in patterns])
    return rows.filter(wanted).orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def recent_window(rows: DataFrame, as_of: datetime, hours: int, cap: int | None = None) -> DataFrame:
    """Rows of the last hours with headline and content, newest first."""
    since = F.lit((as_of - timedelta(hours=hours)).isoformat(" ")).cast("timestamp_ntz")
    kept = rows.filter((F.col("published_at") >= since) & F.col("content").isNotNull() & F.col("headline").isNotNull()).orderBy(F.desc("published_at"), F.desc("id"))
    return kept.limit(cap) if cap else kept


def category_label(category: Column, section: Column) -> Column:
    """A readable category: a numeric one gives way to the section, an empty one to the section or 'Uncategorized'; an empty section gives way to the number."""
    trimmed, own = F.trim(category), F.nullif(F.trim(section), F.lit(""))
    return F.when(trimmed.rlike("^[0-9]+$"), F.coalesce(own, trimmed)).when(F.coalesce(trimmed, F.lit("")) == "", F.coalesce(own, F.lit("Uncategorized"))).otherwise(trimmed)


def reject_reason(headline: Column, published: Column, content: Column, least_content: int = 20) -> Column:
    """Why an article is not taken, the first reason that holds; null: it is."""
    h, d, c = (F.coalesce(F.trim(x.cast("string")), F.lit("")) for x in (headline, published, content))
    return F.when((F.length(h) < 3) | (h == "No headline"), "headline").when(F.length(d) < 10, "date").when(F.length(c) < least_content, "content")


def retry_action(status: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    return F.when(status.isNull(), "new").when(status == "Success", "skip").when(F.coalesce(attempts, F.lit(0)) >= most, "exhausted").otherwise("retry")


def is_asset_url(url: Column) -> Column:
    """An address that may be an article's image."""
    return F.coalesce(~url.startswith("data:") & (F.length(url) >= 20) & ~F.lower(url).rlike("|".join(NO_IMAGE_WORDS)), F.lit(False))


def url_day(url: Column) -> Column:
    """The day of a /yyyy/mm/dd/ in an address, null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"/(\d{4})/(\d{2})/(\d{2})/", i), F.lit("")).cast("int")
    return F.make_date(part(1), part(2), part(3))


def by_status(rows: DataFrame, status: str = "all", site: str | None = None) -> DataFrame:
    """Categories that are all, active or disabled, of one site or any."""
    kept = rows if status == "all" else rows.filter(F.col("is_active") == int(status == "active"))
    return kept.filter(F.col("site") == site) if site else kept


def enabled(keywords: DataFrame) -> DataFrame:
    return keywords.filter("is_active = 1")


def unread(matches: DataFrame) -> DataFrame:
    return matches.filter("is_read = 0")
