"""Exports and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.fold import value_of
from tidemark.session import numbered


def csv_rows(findings: DataFrame) -> DataFrame:
    """(category, value, first_seen, last_seen, occurrences, source): findings without a value are left out."""
    return findings.select("category", value_of().alias("value"), "first_seen", "last_seen", "occurrences", F.coalesce("source_url", F.lit("")).alias("source"), "rank").where("value is not null").orderBy("category", "rank").drop("rank")


def json_rows(findings: DataFrame) -> DataFrame:
    """(category, items): each category's findings as one JSON array in rank order, in pieces of 1000."""
    item = F.struct("rank", F.to_json(F.struct("key", "first_seen", "last_seen", "occurrences", "attrs", "source_url")).alias("json"))
    grouped = findings.groupBy("category", F.floor((F.col("rank") - 1) / 1000).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("category", "part", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["json"]), ","), F.lit("]")).alias("items"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(category, place, line): the lines of a Markdown report by category."""
    line = F.concat(F.lit("- "), value_of(), F.lit(" ("), F.col("first_seen"), F.lit(" to "), F.col("last_seen"), F.lit(", "), F.col("occurrences"), F.lit("x)"))
    return findings.select("category", F.col("rank").alias("place"), line.alias("line")).where("line is not null").orderBy("category", "place")


def upsert(old: DataFrame, new: DataFrame, key: str, preserve: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; ``preserve`` columns keep their old values."""
    kept = old.join(new.select(key), key, "left_anti")
    if preserve:
        before = old.select(key, *[F.col(c).alias(f"_{c}") for c in preserve])
        new = new.join(before, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in preserve else F.col(c) for c in new.columns])
    return kept.unionByName(new.select(*old.columns))


def live_scans(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """One row for each key: the live one where there is one."""
    both = live.withColumn("_p", F.lit(0)).unionByName(stored.withColumn("_p", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")


def purge_orphans(index: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    return index.join(scans.select(key).distinct(), key, "left_semi")


#: The columns of the client's CSV.
CLIENT_COLUMNS = ("category", "value", "severity", "first_seen", "last_seen", "occurrences", "type", "provider", "service", "domain", "source_url", "source_page_id", "md5", "sha256", "shodan")


def client_csv(findings: DataFrame) -> DataFrame:
    """(place, line): header and rows of the client's CSV; a value with a quote, comma or line end is quoted.

    ``findings`` carry value and severity; what they lack of the columns comes from
    their attributes, else it is empty.
    """
    have = set(findings.columns)

    def field(name: str) -> Column:
        raw = F.coalesce((F.col(name) if name in have else F.col("attrs")[name]).cast("string"), F.lit(""))
        return F.when(raw.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(raw)

    body = numbered(findings, "_line", F.col("category"), F.col("rank")).select(F.col("_line").cast("long").alias("place"), F.concat_ws(",", *map(field, CLIENT_COLUMNS)).alias("line"))
    head = findings.sparkSession.createDataFrame([(0, ",".join(CLIENT_COLUMNS))], "place long, line string")
    return head.unionByName(body)


def json_export(scans: DataFrame, tool: str, exported_at: str) -> DataFrame:
    """(url_id, json): the export of each stored scan, its ``meta`` and ``results`` being JSON texts already."""
    told = F.to_json(F.struct(F.lit(tool).alias("tool"), "domain", "url_id", F.lit(exported_at).alias("exported_at"), "completed_at"))
    whole = F.concat(F.rtrim(told, F.lit("}")), F.lit(',"meta":'), F.coalesce("meta", F.lit("null")), F.lit(',"results":'), F.coalesce("results", F.lit("{}")), F.lit("}"))
    return scans.select("url_id", whole.alias("json"))


def html_pages(scans: DataFrame, template: str, name: str) -> DataFrame:
    """(url_id, html): the template with each scan's JSON as a script in its head, safe against closing tags inside."""
    script = F.concat(F.lit(f"<script>window.{name} = "), F.replace(F.col("json"), F.lit("</"), F.lit("<\\/")), F.lit(";</script>"))
    before, found, after = template.partition("</head>")
    page = F.concat(F.lit(before), script, F.lit(found + after)) if found else F.concat(script, F.lit(template))
    return scans.select("url_id", page.alias("html"))


def without_scan(scans: DataFrame, index: DataFrame, url_id: str) -> tuple[DataFrame, DataFrame]:
    """The scans and the text index without one scan."""
    return scans.where(F.col("url_id") != url_id), index.where(F.col("scan") != url_id)


def without_expired(scans: DataFrame, index: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The scans that live after ``now`` (no expiry: for ever), and the index rows of these."""
    kept = scans.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return kept, index.join(kept.select(F.col("url_id").alias("scan")).distinct(), "scan", "left_semi")
