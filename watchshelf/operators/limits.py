"""Rate windows and locks over tables of events, as joins and windows alone.

A key's state is empty at some events (fresh ones), and whatever happens at a fresh event, the next fresh one after it is
known at once: where the window has passed, or where a success has cleared the count. So every event points to one later
event; the fresh ones are those reached from a key's first event, or from an event that follows a gap as long as a
window, and are found by doubling the pointers. What the rule says of an event follows from counts since its last fresh
event. Counts run over ranges of (key, time), not over keys, so a key with a third of all events is many tasks'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordered import RANGE, ranged, running


@dataclass(frozen=True)
class Rule:
    """At most `limit` hits in `seconds` from a key's first one; with `resets`, a success clears the count."""

    limit: int
    seconds: int
    resets: bool = False


def _reached(start: DataFrame, jump: DataFrame) -> DataFrame:
    """n of all that the jumps (n, to) reach from start; no two ways meet."""
    while not jump.isEmpty():
        start = written(start.union(start.join(jump, "n").select("to")), "reached")
        jump = written(jump.join(jump.select(F.col("n").alias("to"), F.col("to").alias("far")), "to").select("n", F.col("far").alias("to")), "jumps")
    return start


def limited_table(events: DataFrame, rule: Rule, ranges: int | None = None) -> DataFrame:
    """Each event (key, event_id, ts, success) with its place in its key's window and whether the rule allows it. Events without a key are left out; null success is none."""
    own = events.filter("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("success", F.lit(False)).alias("success"))
    own = own.withColumns({"at": F.unix_micros("ts"), "kind": F.lit(1)})
    # each event asks for the place of the first one that its window doesn't cover; the questions are in the order of the events
    asked = own.withColumns({"at": F.col("at") + rule.seconds * 1_000_000, "kind": F.lit(0)})
    order = [F.col(c) for c in ("key", "at", "kind", "event_id", "success")]
    event, good = F.col("kind") == 1, F.col("success")
    one = lambda what: F.when(what, 1).otherwise(0)
    counted = running(ranged(own.unionByName(asked), order, ranges), order, {"n": one(event), "m": one(~event), "fails": one(event & ~good), "goods": one(event & good)})
    counted = written(counted, "counted")
    rows = counted.filter(event).drop("m", "kind", "at")
    nodes = rows.join(counted.filter(~event).select(F.col("m").alias("n"), (F.col("n") + 1).alias("past")), "n")
    following = F.col("past")
    if rule.resets:
        success = rows.filter(good).select((F.col("goods") - 1).alias("goods"), F.col("n").alias("good_n"), F.col("fails").alias("good_fails"))
        nodes = nodes.join(success, "goods", "left")
        clears = (F.col("good_n") < F.col("past")) & (F.col("good_fails") - F.col("fails") + 1 < rule.limit)
        following = F.when(good, F.col("n") + 1).when(clears, F.col("good_n") + 1).otherwise(F.col("past"))
    pointed = written(nodes.select("n", "past", following.alias("to")), "pointed")
    # after a gap as long as a window, or as the first of its key
    certain = pointed.filter(F.col("past") == F.col("n") + 1).select("past").union(pointed.sparkSession.range(1, 2)).toDF("n")
    inner = pointed.select("n", "to").join(certain.withColumnRenamed("n", "to"), "to", "left_anti").select("n", "to")
    fresh = _reached(certain, inner).select("n", F.lit(True).alias("fresh"))
    start = F.when(F.col("fresh"), F.struct("n", "fails", "success"))
    judged = running(rows.join(fresh, "n", "left"), order=[F.col("n")], maxes={"start": start})
    if not rule.resets:
        hits = F.col("n") - F.col("start.n") + 1
        return judged.select("key", "event_id", "ts", hits.alias("hits"), (hits <= rule.limit).alias("allowed"))
    fails = F.when(F.col("start.success"), 0).otherwise(F.col("fails") - F.col("start.fails") + 1)
    allowed = fails - F.when(good, 0).otherwise(1) < rule.limit
    hits = F.when(good & allowed, 0).otherwise(F.least(fails, F.lit(rule.limit)))
    return judged.select("key", "event_id", "ts", hits.cast("long").alias("hits"), allowed.alias("allowed"))
