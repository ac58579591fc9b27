"""Previews that expire: stored, read, overwritten, completed and invalidated by key, for a stream and for a table.

Events are key, event_id, ts, op and value. `save` stores a pending preview for `seconds`; `complete` stores its result
for as long again, so that it can be asked for once more; `invalidate` marks what is stored and leaves its end as it is;
any other op only reads. Each event gives the status after it (PENDING, COMPLETED, INVALIDATED, or MISSING where nothing
is stored or all has expired) and the value stored. Events of a key follow each other by ts, then event_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.ordered import RANGE, ranged, running

SEEN = "key string, event_id long, ts timestamp, op string, status string, value string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an op stores.
STORES = {"save": "PENDING", "complete": "COMPLETED"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which transformWithState needs; on disk, so it may outgrow memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Previews(StatefulProcessor):
    """One preview for each key. By event time a timer frees it at its end; by the clock (live) the store's own time to live does."""

    def __init__(self, seconds: int, live: bool):
        self.seconds, self.live = seconds, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("preview", "status string, value string, ends long", self.seconds * 1000 if self.live else None)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = was = self.kept.get() if self.kept.exists() else None
        out = []
        for event_id, ts, op, value in zip(own.event_id, own.ts, own.op, own.value, strict=True):
            at = ts.value // 1000
            if state is not None and at >= state[2]:
                state = None
            if op in STORES:
                state = (STORES[op], value, at + self.seconds * 1_000_000)
            elif op == "invalidate" and state is not None:
                state = ("INVALIDATED", *state[1:])
            status, stored = state[:2] if state is not None else ("MISSING", None)
            out.append((key[0], event_id, ts, op, status, stored))
        if state is None:
            self.kept.clear()
        elif state != was:
            self.kept.update(state)
            if not self.live and (was is None or state[2] != was[2]):
                self.handle.registerTimer(state[2] // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "op", "status", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A preview that was stored again meanwhile has a timer of its own and stays."""
        if self.kept.exists() and self.kept.get()[2] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def previewed(events: DataFrame, seconds: int = 600, late: str = "1 minute", live: bool = False) -> DataFrame:
    """Each event of a stream with the status after it; start the stream inside rocks().

    live: lives are measured by the clock, not by ts, and the stream goes on until it is stopped, even with a trigger
    that takes what is there; else events later than the watermark are left out.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "op", "value").filter("key IS NOT NULL")
    rows = rows if live else rows.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Previews(seconds, live), outputStructType=SEEN, outputMode="Append", timeMode="ProcessingTime" if live else "EventTime")


def previewed_table(events: DataFrame, seconds: int = 600, ranges: int | None = None) -> DataFrame:
    """The same over a table, by windows over ranges of (key, time): what is alive after an event is what was stored last, unless its time is over."""
    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "op", "value").filter("key IS NOT NULL")
    order = [F.col(c) for c in ("key", "ts", "event_id", "op")]
    # rows are in this order, so the largest of these so far is the last
    stored = F.when(F.col("op").isin(list(STORES)), F.struct("key", "ts", "event_id", "op", "value"))
    marked = F.when(F.col("op") == "invalidate", F.struct("key", "ts", "event_id"))
    seen = running(ranged(rows, order, ranges), order, maxes={"stored": stored, "marked": marked})
    alive = (F.col("stored.key") == F.col("key")) & (F.col("ts") < F.timestamp_add("SECOND", F.lit(seconds), F.col("stored.ts")))
    after = F.col("marked") > F.struct("stored.key", "stored.ts", "stored.event_id")
    status = F.when(after, "INVALIDATED").otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in STORES.items() for x in pair]), F.col("stored.op")))
    return seen.drop(RANGE).select("key", "event_id", "ts", "op", F.when(alive, status).otherwise("MISSING").alias("status"), F.when(alive, F.col("stored.value")).alias("value"))
