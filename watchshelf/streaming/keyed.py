"""State for each key: windows that open at the first hit, locks after failures, and values that expire."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Rule

HITS = "key string, event_id long, ts timestamp, hits long, allowed boolean"


def step(rule: Rule, opened: float | None, hits: int, at: float, success: bool) -> tuple[float | None, int, bool]:
    """The state after one event, and whether it was allowed: (when the window opened, hits in it, allowed)."""
    if opened is None or at >= opened + rule.seconds:
        opened, hits = None, 0
    if rule.resets:
        if hits >= rule.limit:
            return opened, hits, False
        return (None, 0, True) if success else (at if opened is None else opened, hits + 1, True)
    return (at if opened is None else opened), hits + 1, hits + 1 <= rule.limit


def limited(events: DataFrame, rule: Rule, late: str = "1 hour") -> DataFrame:
    """Each event (key, event_id, ts, success) of a stream with its place in its key's window and whether the rule allows it.

    Within a micro-batch a key's events are taken in the order of ts and event_id; events later than the watermark are
    left out. Idle keys give up their state once the watermark has passed their window.
    """

    def advance(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, hits = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, success in zip(rows.event_id, rows.ts, rows.success, strict=True):
            opened, hits, allowed = step(rule, opened, hits, ts.timestamp(), bool(success))
            out.append((key[0], event_id, ts, hits, allowed))
        state.update((opened, hits))
        ends = int(((rows.ts.iloc[-1].timestamp() if opened is None else opened) + rule.seconds) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "hits", "allowed"])

    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), "success").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(advance, HITS, "opened double, hits long", "append", GroupStateTimeout.EventTimeTimeout)


def with_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the limit and window of their endpoint's rule; events of other endpoints are dropped."""
    return events.join(rules, "endpoint")


def alive(snapshots: DataFrame, as_of, seconds: int = 600, created: str = "created_at") -> DataFrame:
    """Snapshots that haven't expired at as_of."""
    return snapshots.filter(F.timestamp_add("SECOND", F.lit(seconds), F.col(created)) > as_of)


def latest_alive(snapshots: DataFrame, key: str, as_of, seconds: int = 600, created: str = "created_at") -> DataFrame:
    """Each key's newest snapshot that hasn't expired, as a struct."""
    whole = F.struct(*[c for c in snapshots.columns if c != key])
    return alive(snapshots, as_of, seconds, created).groupBy(key).agg(F.max_by(whole, created).alias("snapshot"))
