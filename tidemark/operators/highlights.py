"""Rule-based highlights: conditional aggregates over the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
SEVERITY = {"LEAK": 0, "PIVOT": 1, "CONTEXT": 2, "BACKGROUND": 3}
GENERIC_MAILBOXES = ("info", "contact", "support", "hello", "team", "office", "marketing", "press", "sales", "rgpd", "dpo", "careers", "handicap", "accessibilite", "hr", "recruiting")
INTERESTING_ENDPOINT = r"(?i)^/(api|admin|login|auth|dashboard|internal|staging|debug|graphql)"

a = lambda name: F.col("attrs")[name]


def _rules(domain: str) -> list[tuple[str, str, str, Column, str]]:
    """(severity, shown category, category, condition, attribute of the type shown or empty)."""
    local = F.substring_index("key", "@", 1)
    named = F.col("key").endswith(f"@{domain}") & ~local.rlike("^(" + "|".join(GENERIC_MAILBOXES) + ")$") & local.rlike("[.-]")
    changed = F.col("first_seen") != F.col("last_seen")
    yes, secret = F.lit(True), F.coalesce(a("tier"), F.lit("secret")) == "secret"
    sensitive = F.coalesce(a("sensitive_claims"), F.lit("")) != ""
    file_kind = a("kind").isin("security", "ads")
    js = F.lower(a("url")).rlike("/api|/internal|/admin|/staging|/debug")
    return [
        ("LEAK", "api_keys", "api_keys", secret, "type"),
        ("PIVOT", "api_keys_public", "api_keys", ~secret, "type"),
        ("LEAK", "cloud_buckets", "cloud_buckets", yes, ""),
        ("LEAK", "connection_strings", "connection_strings", a("has_credentials") == "true", "type"),
        ("LEAK", "directory_listings", "directory_listings", yes, ""),
        ("LEAK", "jwt_tokens", "jwt_tokens", sensitive, ""),
        ("LEAK", "internal_ips", "internal_ips", yes, ""),
        ("PIVOT", "subdomains", "subdomains", yes, ""),
        ("PIVOT", "emails", "emails", named, ""),
        ("PIVOT", "endpoints", "endpoints", F.col("key").rlike(INTERESTING_ENDPOINT), ""),
        ("PIVOT", "analytics_trackers", "analytics_trackers", yes, "type"),
        ("PIVOT", "persons", "persons", yes, ""),
        ("PIVOT", "technologies", "technologies", changed, ""),
        ("PIVOT", "jwt_tokens", "jwt_tokens", ~sensitive, ""),
        ("PIVOT", "favicons", "favicons", changed, ""),
        ("PIVOT", "crypto_addresses", "crypto_addresses", yes, "type"),
        ("PIVOT", "verification_tags", "verification_tags", yes, "service"),
        ("PIVOT", "adsense_ids", "adsense_ids", a("type") == "adsense_publisher", ""),
        ("PIVOT", "hidden_fields", "hidden_fields", yes, ""),
        ("PIVOT", "js_urls", "js_urls", js, ""),
        ("PIVOT", "github_repos", "github_repos", yes, ""),
        ("PIVOT", "pgp_keys", "pgp_keys", yes, "kind"),
        ("PIVOT", "sitemaps_and_robots", "sitemaps_and_robots", file_kind, "kind"),
        ("CONTEXT", "hosting", "hosting", yes, "provider"),
        ("CONTEXT", "cookie_consent", "cookie_consent", yes, "platform"),
        ("CONTEXT", "rss_feeds", "rss_feeds", yes, ""),
        ("CONTEXT", "sitemaps_and_robots", "sitemaps_and_robots", ~file_kind, "kind"),
        ("BACKGROUND", "outreach", "social_profiles", yes, "platform"),
        ("BACKGROUND", "outreach", "outgoing_links", a("category") == "other", ""),
    ]


def highlights(findings: DataFrame, domain: str, samples: int = 5) -> DataFrame:
    """(severity, category, n, types, samples): one row for each rule that finds something, most severe first.

    ``findings`` carry ``rank``; samples are the keys of the rule's own first findings, wherever
    these stand in their category. ``n`` and ``types`` count all. Each task sends only the
    first few of a rule, so no list grows with the data.
    """
    rules = _rules(domain)
    tags = F.filter(F.array(*[F.when((F.col("category") == c) & cond, F.struct(F.lit(s).alias("severity"), F.lit(shown).alias("shown"), (a(t) if t else F.lit(None).cast("string")).alias("type"))) for s, shown, c, cond, t in rules]), lambda x: x.isNotNull())
    hit = findings.select("key", "rank", F.explode(tags).alias("t")).select("key", "rank", "t.*")
    rule = ["severity", "shown"]
    grouped = hit.groupBy(*rule).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"))
    first = hit.withColumn("place", F.row_number().over(W.partitionBy(*rule).orderBy("rank", "key"))).where(F.col("place") <= samples)
    shown = first.groupBy(*rule).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]), ", ").alias("samples"))
    order = F.when(F.col("severity") == "LEAK", 0).when(F.col("severity") == "PIVOT", 1).when(F.col("severity") == "CONTEXT", 2).otherwise(3)
    return grouped.join(shown, rule).select("severity", F.col("shown").alias("category"), "n", "types", "samples").orderBy(order, "category")
