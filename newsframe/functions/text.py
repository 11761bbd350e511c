"""Text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that close a headline without belonging to it, as most sites have it, as one has it that keeps a dollar sign, and as one has it that
#: takes a few and then blanks.
TRAILING_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।"
TRAILING_MARKS_NO_DOLLAR = "!\"#%&'()*+,-./:;<=>?@[\\]^_`{|}~।"
FEW_TRAILING_MARKS = "।!?.,:;'\""
#: What a log line says of an article that was inserted or updated, of success and (besides 'error' in any case) of failure, and the states of a job.
INSERTED_TOKENS = ("✓ Inserted new article", "Inserted new article id", "[OK] Inserted new article", "Inserted new article (id", "[OK] Inserted new article (ID:")
UPDATED_TOKENS = ("✓ Updated existing article", "Updating existing article", "[OK] Updated existing article", "Updated existing article (id")
SUCCESS_TOKENS = ("✓ Successfully processed", "✓ SUCCESS")
FAILURE_TOKENS = ("Failed to scrape", "✗")
STATES = ("finding", "extracting", "waiting")


def normalized(text: Column) -> Column:
    """Runs of blanks made one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_trailing_marks(text: Column, marks: str = TRAILING_MARKS, then_trimmed: bool = False) -> Column:
    kept = F.regexp_replace(text, "[" + re.sub(r"([\[\]\\^&-])", r"\\\1", marks) + r"]+\z", "")
    return F.regexp_replace(kept, r"^\s+|\s+$", "") if then_trimmed else kept


def without_last_word(text: Column) -> Column:
    """All words but the last (a watermark); of a single word nothing is left."""
    words = F.split(F.trim(text), r"\s+")
    return F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")


def collapsed_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def truncated(text: Column, keep: int, longest: int | None = None) -> Column:
    """The first `keep` characters and '...' where the text is over `longest` (by default keep)."""
    return F.when(F.length(text) > (longest or keep), F.concat(F.left(text, F.lit(keep)), F.lit("..."))).otherwise(text)


def embedding_text(headline: Column, actual_headline: Column, content: Column, n: int = 500) -> Column:
    """Headline (or the actual one) and the beginning of the content."""
    head = F.coalesce(F.nullif(headline, F.lit("")), actual_headline, F.lit(""))
    return F.trim(F.concat(head, F.lit("\n\n"), F.substring(F.coalesce(content, F.lit("")), 1, n)))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tags(text: Column) -> Column:
    """The parts between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")


def duration(seconds: Column) -> Column:
    """'45s', '3m 20s' or '2h 5m'; a second part of 0 is left out."""
    s = F.floor(seconds)
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    both = lambda x, a, y, b: F.concat(part(x, a), F.when(y > 0, F.concat(F.lit(" "), part(y, b))).otherwise(""))
    return F.when(s < 60, part(s, "s")).when(s < 3600, both(F.floor(s / 60), "m", s % 60, "s")).otherwise(both(F.floor(s / 3600), "h", F.floor(s % 3600 / 60), "m"))


_STATUS = r"\[STATUS:(" + "|".join(STATES) + r"):(.+?)\]"


def status_state(line: Column) -> Column:
    """The state of a '[STATUS:state:detail]' line, null for others and for states that are none of STATES."""
    return F.nullif(F.regexp_extract(line, _STATUS, 1), F.lit(""))


def status_detail(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, _STATUS, 2), F.lit(""))


def progress(line: Column) -> Column:
    """(i, n) of a 'PROGRESS i n' line."""
    part = lambda k: F.nullif(F.regexp_extract(line, r"PROGRESS (\d+) (\d+)", k), F.lit("")).cast("int")
    return F.struct(part(1).alias("i"), part(2).alias("n"))


def log_flags(line: Column) -> Column:
    """What a log line tells. processed: an insert or update counts one, success one more; a line may tell of both."""
    any_of = lambda tokens: reduce(or_, (line.contains(t) for t in tokens))
    inserted, updated, success = any_of(INSERTED_TOKENS), any_of(UPDATED_TOKENS), any_of(SUCCESS_TOKENS)
    error = F.lower(line).contains("error") | any_of(FAILURE_TOKENS)
    return F.struct(inserted.alias("inserted"), updated.alias("updated"), success.alias("success"), error.alias("error"), ((inserted | updated).cast("int") + success.cast("int")).alias("processed"))


def word_set(text: Column, lower: bool = False) -> Column:
    """Distinct runs of anything but blanks; none for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(F.lower(text) if lower else text, F.lit("")), r"\s+"), lambda w: w != ""))


def overlap(x: Column, y: Column) -> Column:
    """Of two word sets those in common over all; 0 where neither has any."""
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def jaccard(a: Column, b: Column, lower: bool = False) -> Column:
    """Distinct words in common over all distinct words, as they are written; 0 where neither has any."""
    return overlap(word_set(a, lower), word_set(b, lower))
