"""Localized dates as Column expressions: null where a text has no valid date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, month names and markers of the Bengali texts.
DIGITS = "০১২৩৪৫৬৭৮৯"
MONTHS = ("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("শনিবার", "রবিবার", "সোমবার", "মঙ্গলবার", "বুধবার", "বৃহস্পতিবার", "শুক্রবার")
AM, PM = "এএম|পূর্বাহ্ন|AM|am", "পিএম|অপরাহ্ন|PM|pm"
PREFIXES = "প্রকাশিত|প্রকাশ|আপডেট|Publish|Update"

_DAY = r"(\d{1,2})\s+(\S+?)\s+(\d{4})"
_CLOCK = r"(\d{1,2}):(\d{2})"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DIGITS, "0123456789")


def _same_letters(text: Column) -> Column:
    """One spelling of the letter that Unicode writes in two ways."""
    return F.replace(text, F.lit("য়"), F.lit("য়"))


def month_number(name: Column) -> Column:
    """1 to 12 of a Bengali month, or of an English one or its first three letters; else null."""
    names = {m.replace("য়", "য়"): i for i, m in enumerate(MONTHS, 1)} | {m: i for i, m in enumerate(ENGLISH_MONTHS, 1)} | {m[:3]: i for i, m in enumerate(ENGLISH_MONTHS, 1)}
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(_same_letters(name)))


def _plain(text: Column) -> Column:
    without = F.regexp_replace(ascii_digits(text), rf"({PREFIXES})\s*[:ঃ]?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(without, "|".join(WEEKDAYS), " "), r"[\s‌]+", " "))


def _get(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _hour(text: Column, hour: Column, bare_twelve_is_zero: bool = False) -> Column:
    """24 hours from 12 by the marker in the text; without one as it stands (or 12 as 0, as one site has it)."""
    hour = hour.cast("int")
    pm, am = text.rlike(PM), text.rlike(AM)
    bare = F.when(hour == 12, 0).otherwise(hour) if bare_twelve_is_zero else hour
    return F.when(pm, F.when(hour == 12, 12).otherwise(hour + 12)).when(am, F.when(hour == 12, 0).otherwise(hour)).otherwise(bare)


def _stamp(text: Column, pattern: str, day: int | None, clock: int | None, bare: bool = False) -> Column:
    """The time by a pattern, whose groups from `day` on are day, month, year and from `clock` on hour and minute."""
    d, m, y = (_get(text, pattern, day + k) for k in range(3))
    hour = _hour(text, _get(text, pattern, clock), bare) if clock else F.lit(0)
    minute = _get(text, pattern, clock + 1).cast("int") if clock else F.lit(0)
    return F.try_make_timestamp_ntz(y.cast("int"), month_number(m), d.cast("int"), hour, minute, F.lit(0))


def date_first(text: Column, bare_twelve_is_zero: bool = False) -> Column:
    """'DD Month YYYY, HH:MM' with or without a marker of the half of the day."""
    return _stamp(_plain(text), rf"{_DAY}\s*[,|]?\s*{_CLOCK}", 1, 4, bare_twelve_is_zero)


def date_first_marked(text: Column) -> Column:
    """The same with a marker that must be there."""
    return F.when(text.rlike(f"{AM}|{PM}"), date_first(text))


def piped(text: Column) -> Column:
    """'DD Month YYYY | HH:MM'."""
    return _stamp(_plain(text), rf"{_DAY}\s*\|\s*{_CLOCK}", 1, 4)


def time_first(text: Column, bare_twelve_is_zero: bool = False) -> Column:
    """'HH:MM, DD Month YYYY', a marker after the time or none."""
    return _stamp(_plain(text), rf"{_CLOCK}\s*(?:{AM}|{PM})?\s*,?\s*{_DAY}", 3, 1, bare_twelve_is_zero)


def date_only(text: Column) -> Column:
    """'DD Month YYYY' at midnight; names of weekdays and commas don't matter."""
    return _stamp(F.regexp_replace(_plain(text), ",", " "), _DAY, 1, None)


def either_first(text: Column) -> Column:
    """Time or date first; 12 without a marker is 0."""
    return F.coalesce(time_first(text, True), date_first(text, True))


def any_of_three(text: Column) -> Column:
    return F.coalesce(time_first(text), date_first(text), date_only(text))


def local_to_utc(text: Column, hours: int = 6) -> Column:
    return F.coalesce(date_first(text), date_only(text)) - F.expr(f"INTERVAL {hours} HOURS")


def english(text: Column) -> Column:
    """'Publish : 15 Feb 2026, 07:56 PM ...', or the day alone."""
    return F.coalesce(date_first(text), date_only(text))


def iso_local(text: Column) -> Column:
    """ISO 8601 with its offset dropped."""
    pattern = r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    return F.try_to_timestamp(F.concat_ws(" ", _get(text, pattern, 1), _get(text, pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def meta_time(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def first_valid(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def effective_time(published: Column, modified: Column, mark: Column, end: Column) -> Column:
    """The publication if it is in the window, else the modification if that is, else null: the row is old. The window is (mark, end], without a mark the day of its end."""
    within = lambda t: F.when(mark.isNull(), F.to_date(t) == F.to_date(end)).otherwise((t > mark) & (t <= end))
    return F.when(within(published), published).when(within(modified), modified)
