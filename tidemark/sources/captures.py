"""Capture-index payloads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import host_of, in_time

_ROWS = "array<array<string>>"
#: Fixed value: the header row's first name.
HEADER = "timestamp"


def salvaged(payload: Column) -> Column:
    """The payload's rows; of a truncated one all rows before the cut."""
    whole = F.from_json(payload, _ROWS, {"mode": "PERMISSIVE"})
    cut = F.from_json(F.concat(F.regexp_extract(payload, r"(?s)^(.*\])\s*,", 1), F.lit("]")), _ROWS)
    complete = F.rtrim(payload).endswith("]]") | (F.rtrim(payload) == "[]")
    return F.when(complete, whole).otherwise(cut)


def resume_key(rows: Column) -> Column:
    """The key a paged answer ends with: a last row of one element longer than 20 characters, else null."""
    last = F.try_element_at(rows, F.lit(-1))
    return F.when((F.size(last) == 1) & (F.length(last[0]) > 20), last[0])


def parse_index(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(timestamp, url, status, mimetype, digest): an optional header row and rows of fewer than five fields are skipped."""
    rows = payloads.select(F.posexplode_outer(salvaged(F.col(column))).alias("i", "r")).where("r is not null")
    rows = rows.where((F.size("r") >= 5) & ~((F.col("i") == 0) & (F.col("r")[0] == HEADER)))
    return rows.select(*[F.col("r")[k].alias(n) for k, n in enumerate(("timestamp", "url", "status", "mimetype", "digest"))])


def original_headers(headers: Column) -> Column:
    """The archived response's own headers: prefix removed, names lower-cased."""
    own = F.map_filter(headers, lambda k, v: F.lower(k).startswith("x-archive-orig-"))
    return F.transform_keys(own, lambda k, v: F.regexp_replace(F.lower(k), "^x-archive-orig-", ""))


#: Index records of a page of the index (about), bytes kept of a download, seconds that a cached index lives.
RECORDS_EACH, MOST_BYTES, CACHE_SECONDS = 3000, 10 * 1024 * 1024, 6 * 3600


def url_key(url: Column) -> Column:
    """The index's sort key of a URL: reversed host labels, then path and query, lower-cased."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), F.lower(rest)).otherwise(F.concat(F.lit("/"), F.lower(rest))))


def site_index(captures: DataFrame, domain: str, limit: int | None = None, collapse: str | None = "month") -> DataFrame:
    """What the index answers for a domain and all hosts below it: pages that were found, one a URL and month, or one a URL key, in its order.

    ``limit`` keeps the first rows of that order (it is the index's own bound).
    """
    host = host_of(F.col("url"))
    rows = captures.where((F.col("status") == "200") & (F.col("mimetype") == "text/html") & ((host == domain.lower()) | host.endswith(f".{domain.lower()}")))
    rows = rows.withColumn("_key", url_key(F.col("url")))
    if collapse is not None:
        group = ["url", F.substring("timestamp", 1, 6)] if collapse == "month" else ["_key"]
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*in_time(captures)))).where("_n = 1").drop("_n")
    if limit is not None:
        rows = rows.orderBy("_key", *in_time(captures)).limit(limit)
    return rows.drop("_key")


def size_estimate(index_pages: Column) -> Column:
    """About how many records so many pages of the index hold."""
    return index_pages * RECORDS_EACH


def cached_index(cache: DataFrame, domain: str, now: float, seconds: int = CACHE_SECONDS) -> DataFrame:
    """The cached index of a domain if it is young enough; ``cache(domain, cached_at, ...)`` is partitioned by domain."""
    return cache.where((F.col("domain") == domain) & (F.col("cached_at") > now - seconds))


def error_class(status: Column, failure: Column) -> Column:
    """Why a download gave no page: by HTTP status, else by the kind of ``failure`` (conn, client, blocked, exhausted); null for a page."""
    http = F.when(status == 404, "http_404").when(status == 503, "http_503").when(status.between(400, 499), "http_4xx").when(status >= 500, "http_5xx")
    return F.when(failure.isNotNull(), failure).otherwise(http)


def downloads(selected: DataFrame, responses: DataFrame) -> DataFrame:
    """Selected captures with ``html`` and ``error`` from ``responses(timestamp, url, status, body, failure)``.

    A body is cut to ``MOST_BYTES`` and read as UTF-8 with replacement; a capture without
    a response is ``exhausted``.
    """
    joined = selected.join(responses, ["timestamp", "url"], "left")
    error = F.when(F.col("status").isNull() & F.col("failure").isNull(), "exhausted").otherwise(error_class(F.col("status"), F.col("failure")))
    text = F.try_validate_utf8(F.substring("body", 1, MOST_BYTES).cast("string"))
    valid = F.coalesce(text, F.make_valid_utf8(F.substring("body", 1, MOST_BYTES).cast("string")))
    rest = [c for c in joined.columns if c not in ("status", "body", "failure")]
    return joined.select(*rest, F.when(error.isNull(), valid).alias("html"), error.alias("error"))


def pages_of(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """Selected captures with their downloads; a capture without one keeps a null ``html``."""
    return selected.join(pages, ["timestamp", "url"], "left")


def stamp_of(p: Column) -> Column:
    """A capture time by arithmetic over a page number."""
    return F.concat((2010 + p % 12).cast("string"), F.lpad((1 + (p * 7) % 12).cast("string"), 2, "0"), F.lpad((1 + p % 28).cast("string"), 2, "0"), F.lit("120000"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from a table of (page_id, url, html): time by arithmetic, digest of the page."""
    p = F.col("page_id")
    return pages.select(p.alias("page_seq"), stamp_of(p).alias("timestamp"), "url", F.lit("200").alias("status"), F.lit("text/html").alias("mimetype"), F.md5(F.col("html").cast("binary")).alias("digest"))
