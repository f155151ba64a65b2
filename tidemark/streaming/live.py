"""Structured Streaming: incremental findings, running counts, and the fetch governor as event folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.fold import all_hits, fold

#: Fixed values of the governor (seconds, requests a minute).
SOFT_FAILURES, SOFT_WINDOW, SOFT_OPEN = 5, 120, 180
HARD_REFUSALS, HARD_WINDOW, COOLDOWN, COOLDOWN_MOST, STREAK_RESET = 2, 120, 120, 1800, 900
#: Fixed value: requests that may go at once.
BUCKET = 6.0
RATE_START, RATE_LEAST, RATE_MOST, RATE_STEP, RATE_CLEAN, RATE_CUT = 75.0, 60.0, 80.0, 15.0, 90, 0.5


def running_findings(pages: DataFrame, categories: list[str]) -> DataFrame:
    """The fold over a stream of pages; attributes of the first hit do not depend on arrival order.

    ``captcha_providers`` looks across pages twice and is left to the batch.
    """
    return fold(all_hits(pages, [c for c in categories if c != "captcha_providers"]))


def running_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, time: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than ``delay`` are left out once the watermark has passed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, time: str, gap: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def governor_step(state: dict, at: float, outcome: str) -> dict:
    """The governor after one outcome (``ok``, ``fail`` or ``refused``) at second ``at``."""
    s = dict(state)
    rate, clean = s.get("rate", RATE_START), s.get("clean", at)
    fails = [t for t in s.get("fails", []) if t > at - SOFT_WINDOW]
    refusals = [t for t in s.get("refusals", []) if t > at - HARD_WINDOW]
    streak, hard_until, soft_until = s.get("streak", 0), s.get("hard_until", 0.0), s.get("soft_until", 0.0)
    if outcome == "ok":
        fails, soft_until = [], 0.0
        if at - clean >= RATE_CLEAN:
            rate, clean = min(RATE_MOST, rate + RATE_STEP), at
    else:
        fails.append(at)
        if len(fails) >= SOFT_FAILURES:
            soft_until = at + SOFT_OPEN
    if outcome == "refused":
        refusals.append(at)
        rate, clean = max(RATE_LEAST, rate * RATE_CUT), at
        if len(refusals) >= HARD_REFUSALS:
            streak = 0 if at - s.get("last_hard", at) > STREAK_RESET else streak
            hard_until = at + min(COOLDOWN_MOST, COOLDOWN * 2**streak)
            streak, refusals, s["last_hard"] = streak + 1, [], at
    return s | {"rate": rate, "clean": clean, "fails": fails, "refusals": refusals, "streak": streak, "hard_until": hard_until, "soft_until": soft_until}


def bucket_step(tokens: float, updated: float, at: float, rate: float, capacity: float = BUCKET) -> tuple[float, float, float]:
    """(tokens, updated, granted at) of a request at second ``at`` to a bucket that fills at ``rate`` a minute."""
    now = max(at, updated)
    tokens = min(capacity, tokens + (now - updated) * rate / 60)
    wait = max(0.0, 1 - tokens) * 60 / rate
    return min(capacity, tokens + wait * rate / 60) - 1, now + wait, now + wait


def pacing(requests: DataFrame) -> DataFrame:
    """(host, at, granted): when the token bucket of each host lets a request of ``requests(host, at, rate)`` go.

    A sequential fold by nature: one host's requests go to one task, in order of time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tokens, updated, out = rows.sort_values("at"), BUCKET, None, []
        for r in rows.itertuples():
            tokens, updated, granted = bucket_step(tokens, r.at if updated is None else updated, r.at, r.rate)
            out.append((r.host, r.at, granted))
        return pd.DataFrame(out, columns=["host", "at", "granted"])

    return requests.groupBy("host").applyInPandas(run, "host string, at double, granted double")


def governor(events: DataFrame) -> DataFrame:
    """(host, at, rate, soft_open, hard_open) after each event of ``events(host, at, outcome)``, as a batch fold.

    A sequential fold by nature: one host's events go to one task, in order of time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = {}, []
        for r in rows.sort_values("at").itertuples():
            state = governor_step(state, r.at, r.outcome)
            out.append((r.host, r.at, state["rate"], state["soft_until"] > r.at, state["hard_until"] > r.at))
        return pd.DataFrame(out, columns=["host", "at", "rate", "soft_open", "hard_open"])

    return events.groupBy("host").applyInPandas(run, "host string, at double, rate double, soft_open boolean, hard_open boolean")


def governor_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream: the state of a host is kept between micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        import json

        state, out = json.loads(kept.get[0]) if kept.exists else {}, []
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            state = governor_step(state, r.at, r.outcome)
            out.append((key[0], r.at, state["rate"], state["soft_until"] > r.at, state["hard_until"] > r.at))
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["host", "at", "rate", "soft_open", "hard_open"])

    return events.groupBy("host").applyInPandasWithState(run, "host string, at double, rate double, soft_open boolean, hard_open boolean", "state string", "append", GroupStateTimeout.NoTimeout)
