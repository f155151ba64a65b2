"""Report queries over findings(category, key, value, first_seen, last_seen, occurrences, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import month_index
from tidemark.session import numbered


def bounds(findings: DataFrame) -> DataFrame:
    return findings.agg(F.min("first_seen").alias("lo"), F.max("last_seen").alias("hi"))


def with_presence(findings: DataFrame, hi: str | None = None) -> DataFrame:
    """Adds ``live``: seen in the last month of all. The bounds are one row."""
    if hi is not None:
        return findings.withColumn("live", F.col("last_seen") >= hi)
    top = findings.agg(F.max("last_seen").alias("hi"))
    return findings.crossJoin(F.broadcast(top)).withColumn("live", F.col("last_seen") >= F.col("hi")).drop("hi")


def summary(findings: DataFrame) -> DataFrame:
    rows = with_presence(findings)
    return rows.agg(F.count("*").alias("findings"), F.countDistinct("category").alias("categories"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("gone"))


def lanes(findings: DataFrame) -> DataFrame:
    """Where each finding lies on the time axis, in percent, and whether it is gone."""
    lo, hi = month_index(F.col("lo")), month_index(F.col("hi"))
    span = F.greatest(hi - lo, F.lit(1))
    first, last = month_index(F.col("first_seen")), month_index(F.col("last_seen"))
    rows = findings.crossJoin(F.broadcast(bounds(findings)))  # one row
    return rows.select("category", "key", F.round(100 * (first - lo) / span, 6).alias("left_pct"), F.round(F.greatest(100 * (last - first) / span, F.lit(1.5)), 6).alias("width_pct"), (F.col("last_seen") < F.col("hi")).alias("disappeared"))


def change_feed(findings: DataFrame, last: int | None = None) -> DataFrame:
    """(month, kind, category, key): findings that come up and go down; ``last`` keeps the newest events."""
    rows = with_presence(findings)
    up = F.struct(F.col("first_seen").alias("month"), F.lit("up").alias("kind"))
    down = F.struct(F.col("last_seen").alias("month"), F.lit("down").alias("kind"))
    events = rows.select("category", "key", F.explode(F.when(F.col("live"), F.array(up)).otherwise(F.array(up, down))).alias("e")).select("e.*", "category", "key")
    return events if last is None else events.orderBy(F.desc("month"), "category", "key", "kind").limit(last)


def category_rail(findings: DataFrame, categories) -> DataFrame:
    """Every category with its count, the empty ones too."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def co_occurrence(findings: DataFrame, category: str, key: str, per_category: int = 8) -> DataFrame:
    """Findings introduced by the same page as one finding: the first of each category, and how many there are."""
    own = findings.where((F.col("category") == category) & (F.col("key") == key)).select("source_url")
    peers = findings.join(own, "source_url", "left_semi").where(~((F.col("category") == category) & (F.col("key") == key)))
    totals = peers.groupBy("category").agg(F.count("*").alias("total"))  # a row for each category
    place = F.row_number().over(W.partitionBy("category").orderBy("first_hit", "key"))
    first = peers.withColumn("place", place).where(F.col("place") <= per_category)  # each task keeps its first ones before the shuffle
    return first.join(F.broadcast(totals), "category").select("category", "key", "place", "total")


def top_of_category(findings: DataFrame, text: str = "", live: bool | None = None, rows: int = 200) -> DataFrame:
    """The category block: text filter, presence filter, and the first rows by rank."""
    found = with_presence(findings)
    if text:
        found = found.where(F.contains(F.lower("key"), F.lit(text.lower())))
    if live is not None:
        found = found.where(F.col("live") == live)
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("occurrences"), "first_hit", "key"))
    return found.withColumn("place", place).where(F.col("place") <= rows)


def year_histogram(captures: DataFrame) -> DataFrame:
    """(year, n, pct): captures of each year, years without any filled in, percent of the fullest (2 at least)."""
    years = captures.groupBy(F.substring("timestamp", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n"))
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max("n").alias("top"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("year"), "top")
    filled = every.join(years, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("year", "n", F.greatest(F.lit(2), F.round(100 * F.col("n") / F.col("top")).cast("int")).alias("pct"))


def axis_ticks(findings: DataFrame) -> DataFrame:
    """(year): the labels of a time axis, at most about five, the last year among them."""
    edges = bounds(findings).select(F.substring("lo", 1, 4).cast("int").alias("a"), F.substring("hi", 1, 4).cast("int").alias("z"))
    span = F.greatest(F.col("z") - F.col("a"), F.lit(1))
    step = F.when(span <= 4, 1).otherwise(F.ceil(span / 4)).cast("int")
    return edges.where("a is not null").select(F.explode(F.array_union(F.sequence("a", "z", step), F.array("z"))).alias("year"))


def pivots(findings: DataFrame, categories) -> DataFrame:
    """The categories' distinct values, each with its first finding by rank. ``findings`` carry ``value`` and ``rank``."""
    first = F.row_number().over(W.partitionBy("category", "value").orderBy("rank", "key"))
    return findings.where(F.col("category").isin(*categories)).withColumn("_n", first).where("_n = 1").drop("_n")


def category_activity(findings: DataFrame, category: str, lanes_shown: int = 24) -> DataFrame:
    """Lanes of a category's first findings by rank, on an axis of the category alone; gone is against the whole archive."""
    hi = bounds(findings).select(F.col("hi").alias("archive_end"))
    own = findings.where(F.col("category") == category)
    axis = bounds(own)
    lo, top = month_index(F.col("lo")), month_index(F.col("hi"))
    span = F.greatest(top - lo, F.lit(1))
    first, last = month_index(F.col("first_seen")), month_index(F.col("last_seen"))
    rows = own.where(F.col("rank") <= lanes_shown).crossJoin(F.broadcast(axis)).crossJoin(F.broadcast(hi))  # one row each
    return rows.select("key", "rank", F.round(100 * (first - lo) / span, 6).alias("left_pct"), F.round(F.greatest(100 * (last - first) / span, F.lit(1.5)), 6).alias("width_pct"), (F.col("last_seen") < F.col("archive_end")).alias("faded"))


def composed_activity(findings: DataFrame, categories, chosen: DataFrame) -> DataFrame:
    """(label, first, last, pivot): a lane for each category from its first to its last month, and one for each chosen (category, value)."""
    spans = findings.where(F.col("category").isin(*categories)).groupBy(F.col("category").alias("label")).agg(F.least(F.min("first_seen"), F.min("last_seen")).alias("first"), F.greatest(F.max("first_seen"), F.max("last_seen")).alias("last"))
    own = pivots(findings, categories).join(F.broadcast(chosen), ["category", "value"])  # what a reader has ticked
    return spans.withColumn("pivot", F.lit(False)).unionByName(own.select(F.col("value").alias("label"), F.col("first_seen").alias("first"), F.col("last_seen").alias("last"), F.lit(True).alias("pivot")))


def hosts_by_depth(hosts: DataFrame, deepest: int = 3) -> DataFrame:
    """``hosts(host, domain)``, each once, with ``depth`` below its domain (0 to ``deepest``) and ``place`` from 1, children after their parent.

    Places follow the labels from the last to the first, by code point, over all hosts.
    """
    labels = lambda c: F.split(c, r"\.")
    depth = F.greatest(F.lit(0), F.least(F.lit(deepest), F.size(labels("host")) - F.size(labels("domain"))))
    rows = hosts.where("host is not null").select("host", "domain", depth.alias("depth"), F.array_join(F.reverse(labels("host")), ".").alias("_order")).distinct()
    return numbered(rows, "place", "_order", "domain").drop("_order")


def favicon_strip(findings: DataFrame, shown: int = 6) -> DataFrame:
    """(rank, image, hash, span) of the first icons: the archived image's raw address, a short hash, the months."""
    source = F.coalesce("source_url", F.lit(""))
    image = F.when(source.contains("web.archive.org"), F.regexp_replace(source, r"(/web/\d+)/", "$1im_/")).otherwise("")
    digest = F.substring(F.coalesce(F.nullif(F.col("attrs")["md5"], F.lit("")), F.col("attrs")["sha256"], F.lit("")), 1, 8)
    rows = findings.where((F.col("category") == "favicons") & (F.col("rank") <= shown))
    return rows.select("rank", image.alias("image"), digest.alias("hash"), F.concat_ws(" \u2192 ", "first_seen", "last_seen").alias("span"))


def chip() -> Column:
    """The short label of a finding: its first telling attribute, or the environment in a subdomain's name."""
    named = F.coalesce(*[F.nullif(F.col("attrs")[n], F.lit("")) for n in ("version", "type", "platform", "provider", "service", "kind")])
    environment = F.col("value").rlike(r"(^|\.)(dev|staging|test|preprod|uat|api|admin|internal)\b")
    told = F.when((F.col("category") == "subdomains") & environment, F.substring_index("value", ".", 1))
    return F.substring(F.coalesce(named, told, F.lit("")), 1, 22)
