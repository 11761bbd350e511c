"""Addresses and locations as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight divisions of location labels.
DIVISIONS = ("dhaka", "chittagong", "sylhet", "rajshahi", "khulna", "barisal", "rangpur", "mymensingh")


def canonical_url(href: Column, base: str, host: str | None = None, prefix: str = "/", numeric_end: bool = False) -> Column:
    """The absolute address without query, fragment and closing slash; null if it is of another host, outside the prefix or (numeric_end) doesn't end in a number."""
    host = host or base.split("//")[1].split("/")[0]
    absolute = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).when(href.rlike("^(#|javascript:|mailto:|data:)"), None).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
    plain = F.regexp_replace(F.regexp_replace(absolute, r"[?#].*$", ""), "/+$", "")
    own = F.regexp_extract(plain, "^https?://([^/]+)", 1)
    path = F.regexp_replace(plain, "^https?://[^/]+", "")
    fine = ((own == host) | own.endswith(f".{host}")) & path.startswith(prefix)
    if numeric_end:
        fine = fine & path.rlike("/[0-9]+$")
    return F.when(fine, plain)


def item_id(url: Column) -> Column:
    """The last number that is a path segment, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/(\d+)(?:/[^/\d?#][^/?#]*)*/?(?:[?#].*)?$", 1), F.lit(""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+", ""), r"[?#].*$", ""), "/"), lambda x: x != "")


def slug(url: Column, default: str = "index") -> Column:
    segments = path_segments(url)
    return F.when(F.size(segments) > 0, F.lower(F.element_at(segments, -1))).otherwise(F.lit(default))


def basename(url: Column, drop_query: bool = True) -> Column:
    plain = F.regexp_replace(url, r"[?#].*$", "") if drop_query else url
    return F.element_at(F.split(plain, "/"), -1)


def without_query_keys(url: Column, keys: Sequence[str], defaults: dict[str, str] | None = None) -> Column:
    """The address without some query keys, the other ones in order of name, and defaults for those that are missing."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(list(keys)))
    names = F.transform(pairs, lambda p: F.split(p, "=")[0])
    added = [F.when(~F.array_contains(names, k), F.lit(f"{k}={v}")) for k, v in (defaults or {}).items()]
    whole = F.array_sort(F.concat(pairs, F.array_compact(F.array(*added)))) if added else F.array_sort(pairs)
    bare = F.regexp_replace(url, r"\?.*$", "")
    return F.when(F.size(whole) > 0, F.concat(bare, F.lit("?"), F.array_join(whole, "&"))).otherwise(bare)


def clean_image_url(url: Column) -> Column:
    """An image's address without the parts that sites add for previews: /og/, a -fb ending, a watermark key, a repeated host."""
    plain = F.regexp_replace(url, r"/og/", "/")
    plain = F.regexp_replace(plain, r"-fb\.", ".")
    plain = F.regexp_replace(plain, r"[?&]watermark=[^&]*", "")
    return F.regexp_replace(plain, r"^(https?://[^/]+/)https?:/{1,2}[^/]+/", "$1")


def _location(division: Column, district: Column, upazilla: Column) -> Column:
    return F.struct(division.alias("division"), district.alias("district"), upazilla.alias("upazilla"))


def location_fixed(label: Column, prefix: str) -> Column:
    """'<prefix>-division-district[-upazilla]' by position; null for labels of another beginning or without division and district."""
    parts = F.split(label, "-")
    division, district, upazilla = (F.nullif(F.get(parts, F.lit(prefix.count("-") + 1 + k)), F.lit("")) for k in range(3))
    return F.when(label.startswith(prefix) & division.isNotNull() & district.isNotNull(), _location(division, district, upazilla))


def location_known(label: Column, divisions: Sequence[str] = DIVISIONS) -> Column:
    """'site-division-district[-upazilla]', all that follows the district being the upazilla; null for fewer than three parts and for unknown divisions."""
    parts = F.split(label, "-")
    rest = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "-"))
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(1)).isin(list(divisions)), _location(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), rest))


def location_scan(label: Column, divisions: Sequence[str] = DIVISIONS, marker: str = "country") -> Column:
    """In labels with the marker the first known division among the parts, the next part as district (else the division) and what follows as upazilla; in lower case."""
    parts = F.split(F.lower(label), "-")
    at = F.array_min(F.filter(F.array(*(F.array_position(parts, d) for d in divisions)), lambda p: p > 0)).cast("int")
    division, district, first = (F.nullif(F.get(parts, at - 1 + k), F.lit("")) for k in range(3))
    rest = F.when(first.isNotNull(), F.array_join(F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))), "-"))
    return F.when(F.lower(label).contains(marker) & at.isNotNull(), _location(division, F.coalesce(district, division), rest))


#: Names of the levels below the marker, and of the depths elsewhere.
MARKED_LEVELS = ("Main Category", "Division", "District", "Upazilla", "Area")
LEVELS = ("Root", "Main Category", "Sub-Category", "Sub-Sub Category", "Deep Category")


def level_label(path: Column, label: Column, marker: str = "country-news") -> Column:
    """What the last segment of a path names: by its depth below the marker where the path has it, else by the depth of the label's parts between hyphens."""
    name = lambda names, depth: F.element_at(F.array(*(F.lit(n) for n in names)), F.least(depth, F.lit(len(names) - 1)) + 1)
    below = (F.size(path) - F.array_position(path, marker)).cast("int")
    marked = F.when(F.element_at(path, -1) == marker, MARKED_LEVELS[0]).otherwise(name(MARKED_LEVELS, below))
    return F.when(F.array_contains(path, marker), marked).otherwise(name(LEVELS, F.size(F.split(label, "-")) - 1))
