"""Operator 2: URL filtering with given host/path rules and mined association rules.

The labels are the verdicts of the given rules; URLs that no given rule decides have
none and take no part in mining, but are judged by what it finds. Spark's FP-growth
mines the token combinations of the labelled URLs. Combinations whose confidence for
``block`` or for ``allow`` and whose support suffice become rules, and an inverted index
from each rule's rarest token finds the rules that a URL fulfils. The most confident of
them decides. Rules are a table throughout: mining, pruning and matching are joins.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialise

#: The given rules as (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
MAX_RULE = 3
MAX_FIT_URLS = 1_000_000
#: Items of a row that FP-growth sees together; longer rows go by blocks (see :func:`_baskets`).
MAX_BASKET = 15


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path`` of each row; A-Z of the host lower-cased, both empty without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))


def given_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) columns: the longest given rule that fits host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        host, path = text[:cut], text[cut:]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The distinct tokens of a URL: host labels, path words and query keys; digits fold to one mark."""
    host = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.regexp_extract_all(F.regexp_replace("path", r"[0-9]+", "0"), F.lit(r"[^/._\-]+"), F.lit(0))
    keys = F.regexp_extract_all(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(F.concat(host, F.transform(words, lambda x: F.concat(F.lit("p:"), x)), F.transform(keys, lambda x: F.concat(F.lit("q:"), x))))


class Mined(NamedTuple):
    """Mined rules: ``rules(items, confidence, support, verdict)``, and the tokens of each item, ``items(t, item)``."""

    items: DataFrame
    rules: DataFrame


def _items(folded: DataFrame, least: int) -> DataFrame:
    """(t, item, block, allow): the frequent tokens; those that occur in the same rows share an item.

    An item is named by its rows' number and its first token, so that the rarest of some items is their minimum.
    """
    marks = {"one": F.xxhash64("tokens"), "two": F.xxhash64(F.lit("two"), "tokens")}
    each = folded.select(F.explode("tokens").alias("t"), "block", "allow", *[m.cast("decimal(20,0)").alias(k) for k, m in marks.items()])
    seen = each.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("block", "allow", *marks)]).where(F.greatest("block", "allow") >= least)
    seen = materialise(seen)
    same = ["block", "allow", *marks]
    first = seen.groupBy(*same).agg(F.min("t").alias("head"))
    name = F.concat(F.lpad((F.col("block") + F.col("allow")).cast("string"), 12, "0"), F.lit(":"), "head")
    return seen.join(first, same).select("t", name.alias("item"), "block", "allow")


def _baskets(own: DataFrame, max_rule: int) -> DataFrame:
    """(items): ``own(items, times)`` repeated; of a long row all unions of ``max_rule`` of its blocks instead.

    Every combination of up to ``max_rule`` items of a row lies in one union or more, so
    none is missed; that some are counted more than once only adds candidates.
    """
    block = MAX_BASKET // max_rule
    rows = own.select("items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("items")
    long = rows.where(F.size("items") > block * max_rule).withColumn("blocks", F.ceil(F.size("items") / block).cast("int"))
    for k in range(max_rule):
        low = F.col(f"b{k - 1}") + 1 if k else F.lit(0)
        long = long.withColumn(f"b{k}", F.explode(F.sequence(low, F.col("blocks") - (max_rule - k))))
    union = F.concat(*[F.slice("items", F.col(f"b{k}") * block + 1, block) for k in range(max_rule)])
    return rows.where((F.size("items") > 1) & (F.size("items") <= block * max_rule)).unionAll(long.select(union.alias("items")))


def _within(small: str, large: str) -> Column:
    return F.size(F.array_except(small, large)) == 0


def rules_of(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_fit_urls: int = MAX_FIT_URLS, max_rule: int = MAX_RULE) -> Mined:
    """The rules for both verdicts in ``labelled(tokens, blocked)``.

    Fitted on about ``max_fit_urls`` rows, drawn one by one. Every combination of up to
    ``max_rule`` tokens that reaches the support and the confidence is a rule, unless it
    contains another of at least its confidence. No blocked or no allowed row: no rules.

    Equal rows are folded first, and tokens of the same rows are one item, whichever of
    them a rule names. FP-growth then grows the items of a verdict's rows; items that
    occur with no other verdict are rules alone, and so in no longer one. What it finds
    is counted again over all rows through an index by rarest item.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    sample = labelled if n <= max_fit_urls else labelled.sample(max_fit_urls / n, seed=0)
    rows = sample.select(F.sort_array(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    folded = materialise(rows.groupBy("tokens").agg(F.count_if("blocked").alias("block"), F.count_if(~F.col("blocked")).alias("allow")))
    blocked, allowed = (int(x or 0) for x in folded.agg(F.sum("block"), F.sum("allow")).first())
    n = blocked + allowed
    if not blocked or not allowed:
        discard(folded)
        return Mined(spark.createDataFrame([], "t string, item string"), spark.createDataFrame([], "items array<string>, confidence double, support double, verdict string"))
    least = max(math.ceil(min_support * n), 1)
    items = materialise(_items(folded, least))
    kinds = items.select("t", "item", *[F.when(F.col(other) > 0, F.col("item")).alias(f"mixed_{v}") for v, other in (("block", "allow"), ("allow", "block"))])
    held = folded.withColumn("t", F.explode("tokens")).join(kinds, "t").groupBy("tokens", "block", "allow")
    baskets = materialise(held.agg(*[F.sort_array(F.collect_set(c)).alias(name) for c, name in (("item", "items"), ("mixed_block", "mixed_block"), ("mixed_allow", "mixed_allow"))]).drop("tokens"))
    grown = []
    for verdict in ("block", "allow"):
        own = materialise(_baskets(baskets.where(F.col(verdict) > 0).select(F.col(f"mixed_{verdict}").alias("items"), F.col(verdict).alias("times")), max_rule))
        size = own.count()
        if size:
            found = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / size, 1.0)).fit(own).freqItemsets
            grown.append(materialise(found.where(F.size("items").between(2, max_rule)).select(F.sort_array("items").alias("items"))))
        discard(own)
    counted = items.groupBy(F.array("item").alias("items")).agg(F.first("block").alias("block"), F.first("allow").alias("allow"))
    for more in grown:
        index = more.select(F.col("items").alias("pattern"), F.array_min("items").alias("anchor"))
        lies = baskets.select("items", "block", "allow", F.explode("items").alias("anchor")).join(index, "anchor").where(_within("pattern", "items"))
        counted = counted.unionAll(lies.groupBy(F.col("pattern").alias("items")).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    total = (F.col("block") + F.col("allow")).cast("double")
    each = counted.distinct().withColumn("verdict", F.explode(F.array(F.lit("block"), F.lit("allow")))).withColumn("own", F.when(F.col("verdict") == "block", F.col("block")).otherwise(F.col("allow")))
    good = each.where(F.col("own") >= least).select("items", (F.col("own").cast("double") / total).alias("confidence"), (F.col("own").cast("double") / n).alias("support"), "verdict")
    good = materialise(good.where(F.col("confidence") >= min_confidence))
    part = good.select(F.col("items").alias("part"), F.col("confidence").alias("as_sure"), "verdict", F.array_min("items").alias("anchor"))
    whole = good.where(F.size("items") > 1).select("items", "confidence", "verdict", F.explode("items").alias("anchor"))
    idle = whole.join(part, ["verdict", "anchor"]).where((F.size("part") < F.size("items")) & (F.col("as_sure") >= F.col("confidence")) & _within("part", "items")).select("items", "verdict").distinct()
    rules = materialise(good.join(idle, ["items", "verdict"], "left_anti").select(*good.columns))
    discard(folded, baskets, good, *grown)
    return Mined(items.select("t", "item"), rules)


def spelled_out(mined: Mined, max_rule: int = MAX_RULE) -> DataFrame:
    """(tokens, confidence, support, verdict): a row for every choice of tokens for a rule's items."""
    out = mined.rules.withColumn("tokens", F.array().cast("array<string>"))
    member = mined.items.select(F.col("item").alias("_item"), F.col("t").alias("_t"))
    for k in range(max_rule):
        longer = F.when(F.col("_t").isNull(), F.col("tokens")).otherwise(F.array_append("tokens", F.col("_t")))
        out = out.join(member, F.get("items", F.lit(k)) == F.col("_item"), "left").withColumn("tokens", longer).drop("_item", "_t")
    return out.select(F.sort_array("tokens").alias("tokens"), "confidence", "support", "verdict")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_fit_urls: int = MAX_FIT_URLS) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the rules for ``block``, brought to the driver to be read by people."""
    rules = spelled_out(rules_of(labelled, min_support, min_confidence, max_fit_urls)).where("verdict = 'block'")
    return [(list(r.tokens), r.confidence, r.support) for r in rules.collect()]


def match(pages: DataFrame, mined: Mined) -> DataFrame:
    """Adds ``mined_rule``, ``mined_verdict`` and ``confidence``: of the mined rules whose tokens all occur the most confident, or nulls.

    Of equally confident ones the better supported counts, then ``block``, then the first
    by name. Every distinct set of ``tokens`` is looked up once, in an index by each rule's rarest item.
    """
    sets = pages.select("tokens").distinct().withColumn("t", F.explode("tokens")).join(mined.items, "t")
    named = sets.groupBy("tokens", "item").agg(F.min("t").alias("t")).groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "t"))).alias("own"))
    index = mined.rules.withColumn("anchor", F.array_min("items"))
    lies = named.withColumn("has", F.map_keys("own")).withColumn("anchor", F.explode("has")).join(index, "anchor").where(_within("items", "has"))
    name = F.array_join(F.sort_array(F.transform("items", lambda x: F.element_at("own", x))), " & ")
    rank = F.struct((-F.col("confidence")).alias("sure"), (-F.col("support")).alias("often"), (F.col("verdict") != "block").alias("allows"), name.alias("name"))
    best = lies.groupBy("tokens").agg(F.min(rank).alias("_best"))
    verdict = F.when(F.col("_best.allows"), "allow").when(~F.col("_best.allows"), "block")
    out = pages.join(best, "tokens", "left")
    return out.select(*pages.columns, F.col("_best.name").alias("mined_rule"), verdict.alias("mined_verdict"), (-F.col("_best.sure")).alias("confidence"))


def labelled_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens) of every row: the given rules' verdicts and the tokens to mine."""
    rule, verdict = given_rule(rules)
    found = with_parts(pages).withColumns({"rule": rule, "verdict": verdict, "tokens": F.when(F.col("host") != "", tokens()).otherwise(F.array().cast("array<string>"))})
    return found.drop("url")


def held_out(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row (decided, ruled, right): of a fifth of the decided URLs, kept from mining, how many a mined rule judges, and as the given rule does."""
    decided = labelled_urls(pages, rules).where("verdict is not null").withColumn("blocked", F.col("verdict") == "block")
    fifth = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    judged = match(decided.where(fifth), rules_of(decided.where(~fifth), min_support, min_confidence))
    return judged.agg(F.count("*").alias("decided"), F.count("mined_rule").alias("ruled"), F.count_if(F.col("mined_verdict") == F.col("verdict")).alias("right"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) of every row of ``pages(page_id, url)``.

    The longest given rule decides; where none fits, the most confident mined rule
    that the URL fulfils, and a URL that fulfils none is allowed. A null url or one
    without ``://`` has an empty host and path, fits no given rule and has no tokens:
    allowed. A null page_id is kept, repeated rows are judged each, other columns are
    ignored, and an empty table gives no rows.
    """
    parts = labelled_urls(pages, rules)
    mined = rules_of(parts.where("verdict is not null").select("tokens", (F.col("verdict") == "block").alias("blocked")), min_support, min_confidence)
    judged = match(parts, mined)
    final = F.coalesce("verdict", "mined_verdict", F.lit("allow"))
    ruled = lambda name: F.when(F.col("rule").isNull(), F.col(name)).alias(name)
    return judged.select("page_id", "host", "path", "rule", final.alias("verdict"), ruled("mined_rule"), ruled("confidence"))
