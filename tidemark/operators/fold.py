"""Folding hits into findings, and what is settled after the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import host_of
from tidemark.operators.native_extract import native_hits, prepared
from tidemark.operators.page_extract import page_hits
from tidemark.session import discard, materialise, numbered

ALL_CATEGORIES = (
    "emails", "phones", "subdomains", "api_keys", "cloud_buckets", "analytics_trackers", "endpoints", "assets", "social_profiles", "technologies", "persons", "organizations", "addresses", "linked_documents", "html_comments", "meta_info", "html_titles", "jwt_tokens",
    "directory_listings", "hidden_fields", "internal_ips", "adsense_ids", "verification_tags", "iframe_sources", "js_urls", "connection_strings", "crypto_addresses", "favicons", "outgoing_links", "hosting", "http_headers", "analytics_ids", "french_business_ids",
    "cookie_consent", "rss_feeds", "github_repos", "sitemaps_and_robots", "pgp_keys", "bug_bounty_programs", "captcha_providers", "status_pages", "job_boards", "auth_providers",
)


def url_subdomains(pages: DataFrame) -> DataFrame:
    """Hits from the captures' own URLs; they come before all page hits and have no source."""
    rows = prepared(pages).where("domain is not null and domain <> ''")
    host = host_of(F.col("url"))
    rows = rows.select("page_seq", "month", "domain", host.alias("host"))
    own = F.col("host").endswith(F.concat(F.lit("."), F.lower("domain"))) & (F.col("host") != F.concat(F.lit("www."), F.lower("domain"))) & F.col("host").rlike("^[a-z0-9.-]+$")
    label = F.substring_index("host", ".", 1)
    rows = rows.where(own & ~label.rlike("^-|-$") & (label != ""))
    attrs = F.create_map(F.lit("value"), F.col("host"), F.lit("source"), F.lit("snapshot_url"))
    return rows.select(F.lit(-1).cast("long").alias("page_seq"), F.col("page_seq").alias("hit_seq"), F.lit("subdomains").alias("category"), F.col("host").alias("key"), "month", F.lit(None).cast("string").alias("source_url"), attrs.alias("attrs"))


def raw_hits(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Hits of every requested category (None: all) over ``pages``, captchas unsettled."""
    hits = native_hits(pages, categories).unionByName(page_hits(pages, categories))
    if categories is None or "subdomains" in categories:
        hits = hits.unionByName(url_subdomains(pages))
    return hits


def all_hits(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Hits of every requested category (None: all) over ``pages``."""
    hits = raw_hits(pages, categories)
    return settle_captchas(hits) if categories is None or "captcha_providers" in categories else hits


def settle_captchas(hits: DataFrame) -> DataFrame:
    """Keeps a provider's script-only hit at its first page only, and only if no key came before or with it."""
    provider = F.substring_index("key", ":", 1)
    mine = F.col("category") == "captcha_providers"
    script = mine & F.col("key").endswith(":_script_only")
    firsts = hits.where(mine).groupBy(provider.alias("p")).agg(F.min(F.when(script, F.col("page_seq"))).alias("s"), F.min(F.when(~script, F.col("page_seq"))).alias("k"))
    joined = hits.join(F.broadcast(firsts), mine & (provider == F.col("p")), "left")  # a row for each provider of a fixed list
    keep = ~script | ((F.col("page_seq") == F.col("s")) & (F.col("k").isNull() | (F.col("s") < F.col("k"))))
    return joined.where(keep).drop("p", "s", "k")


def fold(hits: DataFrame, *extra: str) -> DataFrame:
    """One finding for each category and key: months, occurrences, and the first hit's attributes and source.

    Counts, bounds and ``min_by`` combine before the shuffle, so a frequent key costs
    one row a task.
    """
    order = F.struct("page_seq", "hit_seq")
    return hits.groupBy(*extra, "category", "key").agg(
        F.min("month").alias("first_seen"),
        F.max("month").alias("last_seen"),
        F.count("*").alias("occurrences"),
        F.min_by("attrs", order).alias("attrs"),
        F.min_by("source_url", order).alias("source_url"),
        F.min(order).alias("first_hit"),
    )


def page_ids(pages: DataFrame) -> DataFrame:
    """(source_url, source_page_id): distinct sources of downloaded pages, numbered from 1 in processing order."""
    first = prepared(pages).where("html is not null").groupBy("source_url").agg(F.min("page_seq").alias("at"))
    return numbered(first, "source_page_id", F.col("at"), F.col("source_url")).select("source_url", F.col("source_page_id").cast("int").alias("source_page_id"))


def ranked(findings: DataFrame) -> DataFrame:
    """Adds ``rank`` in each category: occurrences descending, ties in order of first appearance.

    A large category is not sorted in one task: places are those of all findings in
    ranges, less the first place of the category.
    """
    placed = numbered(findings, "_place", F.col("category"), F.desc("occurrences"), F.col("first_hit"), F.col("key"))
    first = placed.groupBy("category").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "category").withColumn("rank", (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first")


def findings_of(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The whole batch: hits, fold, social/outgoing reconciliation, provenance, rank. ``[]`` gives nothing.

    Hits and findings are read several times below, so each is written once.
    """
    hits = materialise(raw_hits(pages, categories))
    folded = materialise(fold(settle_captchas(hits)).where(F.col("category") != "_errors"))
    discard(hits)
    return finished(folded, page_ids(pages), categories)


def finished(folded: DataFrame, ids: DataFrame, categories: list[str] | None) -> DataFrame:
    """What follows the fold: social/outgoing reconciliation, provenance by ``ids(source_url, source_page_id)``, rank."""
    if categories is not None:
        folded = folded.where(F.col("category").isin(*categories)) if categories else folded.limit(0)
    return ranked(reconcile_social(folded).join(ids, "source_url", "left"))


def reconcile_social(findings: DataFrame) -> DataFrame:
    """Outgoing links that are known profiles go; those of platforms without a pattern become profiles."""
    social_link = (F.col("category") == "outgoing_links") & (F.col("attrs")["category"] == "social")
    url = F.col("attrs")["url"]
    rest = F.regexp_replace(url, r"^[^:/]*://", "")
    path = F.when(F.instr(rest, "/") > 0, F.regexp_replace(rest, r"^[^/]*/", "")).otherwise("")
    handle = F.substring_index(F.substring_index(F.regexp_replace(path, r"^/+|/+$", ""), "/", 1), "?", 1)
    service = F.col("attrs")["service"]
    profile = F.concat_ws(":", service, F.lower(F.when(handle != "", handle).otherwise(url)))
    known = findings.where("category = 'social_profiles'").select(F.col("key").alias("known")).distinct()
    joined = findings.withColumn("_profile", F.when(social_link, profile)).join(known, F.col("_profile") == F.col("known"), "left")
    promote = social_link & ~service.isin(*[p for p, _ in rules.SOCIAL]) & (handle != "")
    kept = joined.where(F.col("known").isNull())
    attrs = F.create_map(F.lit("platform"), service, F.lit("handle"), handle, F.lit("url"), url)
    moved = kept.where(promote).withColumns({"category": F.lit("social_profiles"), "key": F.col("_profile"), "attrs": attrs, "source_url": F.lit(None).cast("string")})
    moved = moved.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("first_hit"))).where("_n = 1").drop("_n")
    return kept.where(~F.coalesce(promote, F.lit(False))).unionByName(moved).drop("_profile", "known")


def merge_analytics(findings: DataFrame) -> DataFrame:
    """Folds analytics_ids into analytics_trackers by identifier: widest months, larger count, missing pivots filled."""
    norm = F.upper(F.trim(F.coalesce(F.col("attrs")["id"], F.col("attrs")["id_value"])))
    tagged = findings.withColumn("_id", norm)
    ids = tagged.where("category = 'analytics_ids'")
    trackers = tagged.where("category = 'analytics_trackers'").withColumn("_n", F.row_number().over(W.partitionBy("_id").orderBy("occurrences", "first_hit")))
    best = ids.groupBy("_id").agg(F.min("first_seen").alias("f"), F.max("last_seen").alias("l"), F.max("occurrences").alias("o"), F.min_by("attrs", "first_hit").alias("a"), F.min("first_hit").alias("h"), F.min_by("source_url", "first_hit").alias("u"))
    joined = trackers.join(best, "_id", "left").withColumn("_first", F.row_number().over(W.partitionBy("_id").orderBy(F.desc("occurrences"), "first_hit")) == 1)
    hit = F.col("a").isNotNull() & F.col("_first")
    filled = F.map_concat("attrs", F.map_filter(F.col("a"), lambda k, v: k.isin("pivot_url", "platform")))
    widened = joined.withColumns({"first_seen": F.when(hit, F.least("first_seen", "f")).otherwise(F.col("first_seen")), "last_seen": F.when(hit, F.greatest("last_seen", "l")).otherwise(F.col("last_seen")), "occurrences": F.when(hit, F.greatest("occurrences", "o")).otherwise(F.col("occurrences")), "attrs": F.when(hit, filled).otherwise(F.col("attrs"))})
    columns = [c for c in findings.columns]
    fresh = best.join(trackers.select("_id").distinct(), "_id", "left_anti")
    item = F.create_map(F.lit("type"), F.col("a")["platform"], F.lit("id"), F.col("a")["id_value"], F.lit("pivot_url"), F.col("a")["pivot_url"], F.lit("platform"), F.col("a")["platform"])
    fresh = fresh.select(F.lit("analytics_trackers").alias("category"), F.concat_ws(":", F.col("a")["platform"], F.col("a")["id_value"]).alias("key"), F.col("f").alias("first_seen"), F.col("l").alias("last_seen"), F.col("o").alias("occurrences"), item.alias("attrs"), F.col("u").alias("source_url"), F.col("h").alias("first_hit"))
    rest = findings.where(~F.col("category").isin("analytics_ids", "analytics_trackers"))
    return rest.unionByName(widened.select(*columns), allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


#: The attributes that name a finding, in order of preference, where it is not ``value``.
VALUE_ATTRIBUTES = {
    "analytics_trackers": ("id",), "social_profiles": ("url", "handle"), "technologies": ("technology",), "persons": ("name",), "phones": ("normalized", "raw"), "jwt_tokens": ("token",), "endpoints": ("path",), "directory_listings": ("path", "url"), "organizations": ("name",),
    "linked_documents": ("url",), "html_comments": ("comment",), "meta_info": ("content",), "html_titles": ("content",), "internal_ips": ("ip",), "adsense_ids": ("id",), "verification_tags": ("verification_id",), "iframe_sources": ("url",), "js_urls": ("url",),
    "crypto_addresses": ("address",), "favicons": ("url",), "outgoing_links": ("url",), "hosting": ("provider",), "bug_bounty_programs": ("pivot_url",), "status_pages": ("pivot_url", "slug"), "job_boards": ("pivot_url",), "auth_providers": ("pivot_url",), "assets": ("path",),
    "rss_feeds": ("url",), "github_repos": ("pivot_url",), "sitemaps_and_robots": ("url",), "pgp_keys": ("identifier", "pivot_url"),
}
#: Pairs that are joined: (first, second, separator, shown with the first alone if the second is missing).
VALUE_PAIRS = {"hidden_fields": ("name", "value", ":"), "http_headers": ("type", "value", ": "), "captcha_providers": ("provider", "sitekey", ":"), "analytics_ids": ("platform", "id_value", ":"), "cookie_consent": ("platform", "account_id", ":")}


def value_of():
    """The canonical value of a finding as a column over ``category``, ``key`` and ``attrs``."""
    a = F.col("attrs")
    some = lambda name: F.nullif(a[name], F.lit(""))
    value = some("value")
    for category, names in VALUE_ATTRIBUTES.items():
        cut = 200 if names[0] in ("comment", "content") else 10_000
        value = F.when(F.col("category") == category, F.left(F.coalesce(*map(some, names), some("value")), F.lit(cut))).otherwise(value)
    for category, (one, two, gap) in VALUE_PAIRS.items():
        second = F.left(some(two), F.lit(40)) if category == "hidden_fields" else some(two)
        value = F.when(F.col("category") == category, F.concat_ws(gap, some(one), second)).otherwise(value)
    return F.when(F.col("category") == "addresses", F.col("key")).otherwise(value)
