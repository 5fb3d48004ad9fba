"""Streams over subjob events: last state by subjob, and counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by type and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: What a lease is, as state: status, owner, end of the lease, attempts.
STATE = "status string, owner string, until long, attempt int"
TRACKED = "id long, status string, owner string, attempt int, at long"
LEASE, ATTEMPTS = 60, 3


def _moved(state: tuple, kind: str, owner: str, at: int) -> tuple:
    """A subjob's state after an event; what doesn't fit it, such as a late worker's word, changes nothing."""
    status, holder, until, attempt = state
    held = status in ("CLAIMED", "RUNNING") and holder == owner and at <= until
    if kind == "claim" and status in ("QUEUED", "RETRYING") and attempt < ATTEMPTS:
        return "CLAIMED", owner, at + LEASE, attempt + 1
    if kind == "beat" and held:
        return "RUNNING", holder, at + LEASE, attempt
    if kind == "done" and held:
        return "SUCCEEDED", None, 0, attempt
    if kind == "fail" and held:
        return ("RETRYING" if attempt < ATTEMPTS else "FAILED"), None, 0, attempt
    return state


def track(events: DataFrame, late: str) -> DataFrame:
    """Each subjob's state after its events (id, kind, owner, ts), in event time; a lease that ends without a word is over.

    State is one row a subjob, and a subjob's events of a batch are sorted where they meet.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        now = state.get if state.exists else ("QUEUED", None, 0, 0)
        rows = []
        if state.hasTimedOut:
            if now[0] in ("CLAIMED", "RUNNING"):
                now = ("RETRYING" if now[3] < ATTEMPTS else "FAILED", None, 0, now[3])
                rows.append((key[0], now[0], now[1], now[3], int(state.getCurrentWatermarkMs() // 1000)))
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "kind"]).itertuples():
                at = int(r.ts.timestamp())
                if now[0] in ("CLAIMED", "RUNNING") and at > now[2]:
                    now = ("RETRYING" if now[3] < ATTEMPTS else "FAILED", None, 0, now[3])
                    rows.append((key[0], now[0], now[1], now[3], at))
                new = _moved(now, r.kind, r.owner, at)
                if new != now:
                    rows.append((key[0], new[0], new[1], new[3], at))
                now = new
        state.update(now)
        if now[0] in ("CLAIMED", "RUNNING") and now[2] * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(now[2] * 1000)
        yield pd.DataFrame(rows, columns=["id", "status", "owner", "attempt", "at"])

    grouped = events.withWatermark("ts", late).groupBy("id")
    return grouped.applyInPandasWithState(step, TRACKED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
