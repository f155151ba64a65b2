"""How the archive answers: outcomes, durations, latencies, and the icons fetched from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.checksums import icon_hash

#: The weight of the past in the moving average, the latency window in seconds and samples, what is slow.
PAST, FIRST_SECONDS = 0.9, 180.0
WINDOW, SAMPLES, SLOW, LEAST_SAMPLES = 300, 12, 8.0, 3
#: Failures in a row that make a service slow, and the seconds they lie within.
SLOW_FAILURES, FAIL_WINDOW = 2, 120
#: Icons hashed for a scan, and the bytes of an icon.
MAX_ICONS, ICON_LEAST, ICON_MOST = 16, 16, 512 * 1024
#: Samples of the average: the weight of an older one is below 1e-9.
_KEPT = 200


def outcome_counts(pages: DataFrame) -> DataFrame:
    """(outcome, n): downloads by error class, ``ok`` without one."""
    return pages.groupBy(F.coalesce(F.nullif("error", F.lit("")), F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def scan_totals(pages: DataFrame) -> DataFrame:
    """One row (scraped, failed, blocked): pages with text, pages without, and those of the latter that the archive refused."""
    return pages.agg(F.count_if(F.col("html").isNotNull()).alias("scraped"), F.count_if(F.col("html").isNull()).alias("failed"), F.count_if(F.col("html").isNull() & (F.col("error") == "blocked")).alias("blocked"))


def moving_average(rows: DataFrame, key: str, order: str, value: str, start: float = FIRST_SECONDS) -> DataFrame:
    """``rows`` with ``average``: nine tenths of the last average and one of the value, from ``start`` on.

    A bounded window: older values weigh nothing any more.
    """
    frame = W.partitionBy(key).orderBy(order)
    last = F.collect_list(value).over(frame.rowsBetween(1 - _KEPT, W.currentRow))
    mean = F.aggregate(last, F.lit(start), lambda s, x: PAST * s + (1 - PAST) * x)
    return rows.withColumn("average", mean)


def latency_state(calls: DataFrame, key: str = "host") -> DataFrame:
    """``calls(host, at, seconds)`` with the median of the latest samples in the window, and ``state``: ok, slow or very slow."""
    frame = W.partitionBy(key).orderBy("at").rowsBetween(1 - SAMPLES, W.currentRow)
    fresh = F.filter(F.collect_list(F.struct("at", "seconds")).over(frame), lambda x: x["at"] > F.col("at") - WINDOW)
    rows = calls.withColumn("fresh", F.array_sort(F.transform(fresh, lambda x: x["seconds"])))
    n = F.size("fresh")
    low, high = F.get("fresh", F.floor((n - 1) / 2).cast("int")), F.get("fresh", F.floor(n / 2).cast("int"))
    rows = rows.withColumn("median", (low + high) / 2)
    slow = (n >= LEAST_SAMPLES) & (F.col("median") >= SLOW)
    state = F.when(slow & (F.col("median") >= 2 * SLOW), "very slow").when(slow, "slow").otherwise("ok")
    return rows.select(*calls.columns, n.alias("samples"), "median", state.alias("state"))


def service_state(calls: DataFrame, key: str = "host", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """``calls(host, at, seconds, failed)`` with ``samples``, ``median`` and ``state`` after each call: ok, slow or very slow.

    Samples are the latest calls that did not fail, ``SAMPLES`` at most, of the last
    ``WINDOW`` seconds. A service is slow by their median, or after ``SLOW_FAILURES``
    failures in a row within ``FAIL_WINDOW`` seconds; a call that did not fail ends the row.
    A host's calls are cut into stretches of time, each with those of the stretch before, which
    is all that a state can depend on: a busy host is not one task's. ``order`` is total.
    """
    span = max(WINDOW, FAIL_WINDOW)
    slot = F.floor(F.col("at") / span)
    each = calls.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_slot") == slot)
    frame = W.partitionBy(key, "_slot").orderBy(*order)
    kind = W.partitionBy(key, "_slot", "failed").orderBy(*order).rowsBetween(1 - SAMPLES, W.currentRow)
    sample = F.struct("at", "seconds")
    rows = each.withColumn("_latest", F.when(~F.col("failed"), F.collect_list(sample).over(kind)))
    rows = rows.withColumn("_latest", F.last("_latest", ignorenulls=True).over(frame.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = frame.rowsBetween(1 - SLOW_FAILURES, W.currentRow)
    failing = (F.count_if("failed").over(run) == SLOW_FAILURES) & (F.min("at").over(run) > F.col("at") - FAIL_WINDOW)
    rows = rows.withColumn("_failing", failing).where("_own")
    fresh = F.filter(F.coalesce("_latest", F.array().cast("array<struct<at:double,seconds:double>>")), lambda x: x["at"] > F.col("at") - WINDOW)
    rows = rows.withColumn("fresh", F.array_sort(F.transform(fresh, lambda x: x["seconds"])))
    n = F.size("fresh")
    low, high = F.get("fresh", F.floor((n - 1) / 2).cast("int")), F.get("fresh", F.floor(n / 2).cast("int"))
    rows = rows.withColumn("median", (low + high) / 2)
    slow = F.col("_failing") | (n >= LEAST_SAMPLES) & (F.col("median") >= SLOW)
    state = F.when(slow & (F.col("median") >= 2 * SLOW), "very slow").when(slow, "slow").otherwise("ok")
    return rows.select(*calls.columns, n.alias("samples"), "median", state.alias("state"))


@F.pandas_udf(LongType())
def _icon_hash(content: pd.Series) -> pd.Series:
    return content.map(icon_hash)


def hashed_favicons(findings: DataFrame, blobs: DataFrame) -> DataFrame:
    """Icon findings with ``md5``, ``sha256`` and ``shodan`` for the newest distinct addresses whose bytes are in ``blobs(url, content)``.

    Bytes that are no icon (too few or too many) and missing ones leave nulls; so do
    icons beyond the ``MAX_ICONS`` newest.
    """
    icons = findings.where("category = 'favicons'").withColumn("url", F.col("attrs")["url"])
    first = icons.groupBy("url").agg(F.max("first_seen").alias("newest"))
    targets = first.where("url <> '' and not url like 'data:%'").orderBy(F.desc("newest"), "url").limit(MAX_ICONS)
    sound = blobs.where(F.length("content").between(ICON_LEAST, ICON_MOST)).join(F.broadcast(targets), "url")  # ``MAX_ICONS`` rows
    hashes = sound.select("url", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), _icon_hash("content").alias("shodan"))
    return icons.join(hashes, "url", "left")
