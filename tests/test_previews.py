"""Previews that expire, on streams and tables, and their execution once."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from watchshelf.operators import ledger
from watchshelf.sources.scratch import fresh_path
from watchshelf.streaming import audit, counters, previews

START = datetime(2026, 1, 1)
EVENTS = "key string, event_id long, ts timestamp, op string, value string"


def brute(rows, seconds):
    state, found = {}, {}
    for key, event_id, ts, op, value in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = state.get(key)
        if own and ts >= own[2]:
            own = None
        if op in previews.STORES:
            own = (previews.STORES[op], value, ts + timedelta(seconds=seconds))
        elif op == "invalidate" and own:
            own = ("INVALIDATED", *own[1:])
        state[key] = own
        found[event_id] = own[:2] if own else ("MISSING", None)
    return found


def some_events(n=200):
    rng = random.Random(4)
    return [(f"k{rng.randrange(6)}" if i % 3 else "hot", i, START + timedelta(seconds=i * 40), rng.choice(["save", "complete", "invalidate", "find", "find", "find"]), f"v{i}") for i in range(n)]


def test_a_table_of_previews(spark):
    rows = some_events() + [("edge", 900, START, "save", None), ("edge", 901, START + timedelta(seconds=599), "find", None), ("edge", 902, START + timedelta(seconds=600), "find", None), ("edge", 903, START + timedelta(seconds=600), "invalidate", None)]
    df = spark.createDataFrame([*rows, (None, 950, START, "save", "x")], EVENTS)
    found = previews.previewed_table(df, 600, ranges=5)
    assert {r.event_id: (r.status, r.value) for r in found.collect()} == brute(rows, 600)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_stream_of_previews_in_several_batches(spark, tmp_path):
    """Drained again and again, each time from the state that the last one left; timers free what has ended."""
    rows = some_events(120)
    source, query = str(tmp_path / "in"), None
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = previews.previewed(spark.readStream.schema(EVENTS).parquet(source), 600)
        with previews.rocks(spark):
            query = counters.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.event_id: (r.status, r.value) for r in found.collect()} == brute(rows, 600) and found.count() == len(rows)


def test_a_live_stream_uses_the_time_to_live_of_the_store(spark, tmp_path):
    rows = [("a", 1, START, "save", "x"), ("a", 2, START + timedelta(seconds=1), "find", None), ("b", 3, START, "find", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = previews.previewed(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), 600, live=True)
    with previews.rocks(spark):
        query = stream.writeStream.format("memory").queryName("live_previews").option("checkpointLocation", str(tmp_path / "state")).start()
    try:  # by the clock it goes on until it is stopped
        ends = time.monotonic() + 90
        while time.monotonic() < ends and spark.table("live_previews").count() < 3:
            time.sleep(1)
        assert {r.event_id: r.status for r in spark.table("live_previews").collect()} == {1: "PENDING", 2: "PENDING", 3: "MISSING"}
    finally:
        query.stop()


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def tables(spark):
    shown = [(1, "p", "PENDING", at(10)), (1, "q", "PENDING", at(10)), (2, "p", "PENDING", at(10)), (3, "p", "PENDING", at(0)), (4, "p", "INVALIDATED", at(10)), (5, "empty", "PENDING", at(10))]
    items = [(1, "p", 10, 0, 3), (1, "p", 11, 1, 2), (1, "p", 12, 5, 6), (1, "q", 10, 0, 3), (2, "p", 20, 0, 1), (2, "p", 21, 0, 1), (3, "p", 30, 0, 1), (4, "p", 40, 0, 1)]
    recomputed = [(1, "p", 12, 5, 6), (1, "p", 11, 1, 2), (1, "p", 10, 0, 3), (1, "q", 10, 0, 3), (2, "p", 20, 0, 2), (3, "p", 30, 0, 1), (4, "p", 40, 0, 1)]
    base = [(1, 10, 0, 3), (1, 11, 9, 3), (2, 20, 0, 3), (3, 30, 0, 3), (4, 40, 0, 3), (9, 90, 4, 3)]
    kinds = "user_id long, preview_id string, subject_id long, current_ep_status int, target_ep_status int"
    return {
        "previews": spark.createDataFrame(shown, "user_id long, preview_id string, status string, expires_at timestamp"), "items": spark.createDataFrame(items, kinds), "recomputed": spark.createDataFrame(recomputed, kinds),
        "base": spark.createDataFrame(base, "user_id long, subject_id long, ep_status int, type int"), "ledger": spark.createDataFrame([], ledger.LEDGER),
    }


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, user_id long, preview_id string, at timestamp")


def told(done):
    return {r.request_id: (r.state, r.replayed, r.succeeded, r.skipped, r.failed) for r in done.answers.collect()}


def test_first_repeated_changed_expired_and_unknown(spark, tables):
    requests = asked(spark, (1, 1, "p", at(1)), (2, 1, "p", at(2)), (3, 1, "p", at(20)), (4, 2, "p", at(1)), (5, 2, "p", at(2)), (6, 3, "p", at(1)), (7, 4, "p", at(1)), (8, 7, "p", at(1)), (9, 1, "q", at(3)), (10, 5, "empty", at(3)), (11, None, None, at(1)))
    done = ledger.execute(requests, **tables)
    first = (True, [10], [11], [12])
    assert told(done) == {
        1: ("COMPLETED", False, *first[1:]), 2: ("COMPLETED", *first), 3: ("NOT_FOUND", False, None, None, None), 4: ("PREVIEW_CHANGED", False, None, None, None), 5: ("CONFLICT", False, None, None, None),
        6: ("NOT_FOUND", False, None, None, None), 7: ("CONFLICT", False, None, None, None), 8: ("NOT_FOUND", False, None, None, None), 9: ("BUSY", False, None, None, None), 10: ("COMPLETED", False, [], [], []), 11: ("NOT_FOUND", False, None, None, None),
    }
    assert {(r.user_id, r.subject_id): r.ep_status for r in done.base.collect()} == {(1, 10): 3, (1, 11): 9, (2, 20): 0, (3, 30): 0, (4, 40): 0, (9, 90): 4}
    state = {(r.user_id, r.preview_id): r.status for r in done.previews.collect()}
    new = next(k for k in state if k not in {(1, "p"), (1, "q"), (2, "p"), (3, "p"), (4, "p"), (5, "empty")})
    assert new[0] == 2 and state[new] == "PENDING" and state[2, "p"] == "INVALIDATED" and state[1, "p"] == "COMPLETED" and state[1, "q"] == "PENDING"
    # the new preview holds the recomputation and can be executed; the old answers are replayed, and nothing is written twice
    again = ledger.execute(asked(spark, (20, 1, "p", at(5)), (21, 2, new[1], at(5)), (22, 1, "p", at(11))), done.previews, done.items, done.items, done.base, done.ledger)
    assert told(again) == {20: ("COMPLETED", *first), 21: ("COMPLETED", False, [20], [], []), 22: ("NOT_FOUND", False, None, None, None)}
    assert {(r.user_id, r.subject_id): r.ep_status for r in again.base.collect()}[2, 20] == 2


def test_rows_that_are_held_are_skipped(spark, tables):
    done = ledger.execute(asked(spark, (1, 1, "p", at(1))), **tables, held=F.col("type") == 3)
    assert told(done) == {1: ("COMPLETED", False, [], [10, 11], [12])}


def test_many_requests_for_one_preview(spark, tables):
    many = spark.range(5000).select(F.col("id").alias("request_id"), F.lit(1).cast("long").alias("user_id"), F.lit("p").alias("preview_id"), F.lit(at(1)).alias("at"))
    found = {(r.state, r.replayed): r["count"] for r in ledger.execute(many, **tables).answers.groupBy("state", "replayed").count().collect()}
    assert found == {("COMPLETED", False): 1, ("COMPLETED", True): 4999}


def test_an_audit_batch_that_fails_is_written_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def land(first):
        spark.range(first, first + 50).write.mode("append").parquet(source)

    def drain(write=audit.write_batch):
        return audit.drain_once(spark.readStream.schema("id long").parquet(source), out, state, lambda rows: rows, write)

    def breaks(rows, batch_id, path):
        audit.write_batch(rows, batch_id, path)
        raise RuntimeError("after the write, before the checkpoint")

    land(0)
    drain().awaitTermination()
    land(50)
    with pytest.raises(Exception, match="after the write"):
        drain(breaks).awaitTermination()
    drain().awaitTermination()
    drain().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100))


def test_scratch_paths_are_fresh(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
