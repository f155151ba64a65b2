"""Scalar building blocks as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.functions import rules


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a filter pushed below an alias would repeat it at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def month_of(timestamp: Column) -> Column:
    """``YYYY-MM`` of a 14-digit capture time."""
    return F.concat_ws("-", F.substring(timestamp, 1, 4), F.substring(timestamp, 5, 2))


def month_index(month: Column) -> Column:
    """Months since year 0 of a ``YYYY-MM`` string."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def in_time(captures: DataFrame) -> list[Column]:
    """The order of captures: by time and URL, and by the other columns as they come where several share both, so that no tie is left open."""
    rest = [f.name for f in captures.schema.fields if f.name not in ("timestamp", "url") and not isinstance(f.dataType, MapType)]
    return [F.col(c) for c in ("timestamp", "url", *rest)]


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute or scheme-relative URL, without user and port; empty if there is none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def path_of(url: Column) -> Column:
    """Path of a URL (may be empty)."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.regexp_extract(F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"^([^?#]*)", 1)


def path_norm(url: Column) -> Column:
    """Lower-cased path without trailing slashes; ``/`` for the root."""
    path = F.lower(F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(path == "", "/").otherwise(path)


def without_artefacts(html: Column) -> Column:
    """HTML without what the archive's replay inserted."""
    for pattern in rules.ARCHIVE_ARTEFACTS:
        html = F.regexp_replace(html, pattern, "")
    return html


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum (false for an empty one)."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(numbers, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.when(digits.rlike(r"^\d+$"), total % 10 == 0).otherwise(F.lit(False))


def template(pattern: str, value: Column) -> Column:
    """A URL template with its one ``{}`` filled."""
    if "{}" not in pattern:
        return F.lit(pattern)
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def visible_text(html: Column) -> Column:
    """Text of a page without script, style, noscript and template elements, tags and runs of white space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def mask_password(url: Column) -> Column:
    return F.regexp_replace(url, r"(://[^:@/]*):([^@]+)@", "$1:****@")
