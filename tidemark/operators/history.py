"""Scans that were run: their history, and which of them answers a new request for a domain.

Scans are rows of ``url_id, domain, status, created_at, expires_at``, with a status among
queued, running, completed and failed; ``now`` is a column or a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of a history's length.
LEAST, MOST = 1, 100
LIVE = ("queued", "running")


def recent_scans(scans: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """The newest scans that are not expired, ``limit`` of them (between ``LEAST`` and ``MOST``); ties go by url_id."""
    return scans.where(F.col("expires_at") > now).orderBy(F.desc("created_at"), "url_id").limit(max(LEAST, min(limit, MOST)))


def reused(requests: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """``requests(request_id, domain)`` with ``url_id``, ``status`` and ``live`` of the scan that answers each.

    The oldest queued or running scan of the domain does, else the newest completed one
    that is not expired; with neither, or without a domain, the three are null and a new
    scan has to run. Ties go by url_id. Scans are combined to one row a domain before
    the join, so that a domain of many scans is no hot key.
    """
    is_live = F.col("status").isin(*LIVE)
    usable = scans.where(is_live | ((F.col("status") == "completed") & (F.col("expires_at") > now)))
    chosen = F.struct("url_id", "status")
    oldest = F.min(F.when(is_live, F.struct("created_at", "url_id", chosen.alias("scan"))))["scan"]
    done = usable.where(~is_live).groupBy("domain", "created_at").agg(F.min("url_id").alias("url_id"))
    newest = done.groupBy("domain").agg(F.max_by("url_id", "created_at").alias("_done"))
    live = usable.where(is_live).groupBy("domain").agg(oldest.alias("_live"))
    found = live.join(newest, "domain", "full")
    answer = requests.join(found, "domain", "left")
    live_id = F.col("_live.url_id")
    status = F.when(live_id.isNotNull(), F.col("_live.status")).when(F.col("_done").isNotNull(), "completed")
    known = F.when(live_id.isNotNull(), True).when(F.col("_done").isNotNull(), False)
    return answer.select("request_id", "domain", F.coalesce(live_id, "_done").alias("url_id"), status.alias("status"), known.alias("live"))
