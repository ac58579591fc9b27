"""Streams give what the same rows give as a table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from watchshelf.operators import limits
from watchshelf.streaming import counters, keyed

from conftest import DATA

START = datetime(2026, 1, 1)


def test_window_opens_at_the_first_hit():
    rule, state, hits = keyed.Rule(2, 60), (None, 0), []
    for at in (0, 59, 61):
        *state, allowed = keyed.step(rule, *state, at, True)
        hits.append((state[1], allowed))
    assert hits == [(1, True), (2, True), (1, True)]


def test_lock_after_failures():
    rule, state, said = keyed.Rule(2, 60, resets=True), (None, 0), []
    for at, success in ((0, False), (1, True), (2, False), (3, False), (4, True), (63, True)):
        *state, allowed = keyed.step(rule, *state, at, success)
        said.append(allowed)
    assert said == [True, True, True, True, False, True]


def test_limits_on_a_stream_and_on_a_table(spark, tmp_path):
    rows = [("k" if i % 3 else None if i == 6 else "j", i, START + timedelta(seconds=i * 20), True) for i in range(12)]
    table = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, success boolean").filter("key IS NOT NULL")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = keyed.Rule(2, 60)
    stream = keyed.limited(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), rule)
    counters.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    expected = sorted(map(tuple, limits.limited_table(table, rule).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == expected and len(expected) == 11


def test_daily_counts_of_closed_days(spark, tmp_path):
    events = spark.read.parquet(str(DATA / "events.parquet"))
    events.write.parquet(str(tmp_path / "in"))
    stream = counters.daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", ["event_type"])
    counters.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(r.day, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert found and found.items() <= batch.items() and len(found) >= len(batch) - 10


def test_repeated_events_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, START), (1, START), (2, START)], "event_id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = counters.recent_only(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
    counters.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_snapshots_expire(spark):
    at = F.lit("2026-01-01 00:10:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([("a", START, 1), ("a", START + timedelta(seconds=1), 2), ("b", START, 3)], "key string, created_at timestamp_ntz, v int")
    assert [(r.key, r.snapshot.v) for r in keyed.latest_alive(rows, "key", at).collect()] == [("a", 2)]


def test_rules_by_endpoint(spark):
    events = spark.createDataFrame([("login", 1), ("other", 2)], "endpoint string, event_id long")
    rules = spark.createDataFrame([("login", 5, 60)], "endpoint string, limit int, seconds int")
    assert [r.limit for r in keyed.with_rules(events, rules).collect()] == [5]
