"""Places, running sums and limits over ranges of an order, a hot key in many of them."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from watchshelf.operators import limits, ordered
from watchshelf.streaming import keyed

START = datetime(2026, 1, 1)


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-5, 6), rng.choice([None, rng.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x long, y long").repartition(5)
    order = [F.col("i")]
    dealt = ordered.ranged(df, order, 7)
    assert dealt.select(ordered.RANGE).distinct().count() > 3
    found = {r.i: (r.s, r.m) for r in ordered.running(dealt, order, {"s": F.col("x")}, {"m": F.col("y")}).collect()}
    total, most = 0, None
    for i, x, y in rows:
        total += x
        most = y if most is None else most if y is None else max(most, y)
        assert found[i] == (total, most)


def test_pages_read_their_ranges_only(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    table = ordered.Numbered(df, [F.col("k").desc()], 10)
    assert [(r.k, r.place) for r in table.page(3, 20).collect()] == [(959 - i, 41 + i) for i in range(20)]
    assert sorted((r.place, r.k) for r in table.places().collect()) == [(i + 1, 999 - i) for i in range(1000)]
    assert [r.k for r in table.page(50, 20).collect()] == list(range(19, -1, -1)) and table.page(51, 20).count() == 0
    plan = table.page(25, 20)._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert len(re.findall(r"\d+", re.sub(r"#\d+", "", asked))) <= 2  # of the ten ranges, one or two
    assert ordered.Numbered(df.limit(0), [F.col("k")]).page().count() == 0


def test_strict_stamps(spark):
    rng = random.Random(2)
    stamps = [START + timedelta(microseconds=rng.choice([0, 0, 1, 5]) + i // 10) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(stamps)), "i long, ts timestamp")
    found = [r.strict for r in ordered.strictly_increasing(df, "ts", ["i"], ranges=6).orderBy("i").collect()]
    last, expected = None, []
    for r in sorted(df.select("i", F.unix_micros("ts").alias("us")).collect()):
        last = r.us if last is None or r.us > last else last + 1
        expected.append(last)
    assert found == expected


def brute(rows, rule):
    found, state = {}, {}
    for key, event_id, ts, success in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        *state[key], allowed = keyed.step(rule, *state.get(key, (None, 0)), ts.timestamp(), success)
        found[event_id] = (state[key][1], allowed)
    return found


@pytest.mark.parametrize("rule", [limits.Rule(2, 60), limits.Rule(1, 10), limits.Rule(3, 60, resets=True), limits.Rule(1, 60, resets=True), limits.Rule(2, 5, resets=True)])
def test_limits_against_one_step_after_the_other(spark, rule):
    """A hot key without any gap as long as a window, equal times, lone events and keys of all successes or none."""
    rng = random.Random(3)
    rows = [("hot", i, START + timedelta(seconds=i * 3 + rng.choice([0, 0, 1])), rng.random() < 0.3) for i in range(300)]
    rows += [(f"k{i % 9}", 1000 + i, START + timedelta(seconds=rng.randrange(900)), rng.random() < 0.5) for i in range(200)]
    rows += [("good", 2000 + i, START + timedelta(seconds=i), True) for i in range(20)] + [("bad", 3000 + i, START + timedelta(seconds=20 * i), False) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, success boolean")
    done = limits.limited_table(df, rule, ranges=6)
    assert {r.event_id: (r.hits, r.allowed) for r in done.collect()} == brute(rows, rule)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert limits.limited_table(df.limit(0), rule).count() == 0


def test_the_hot_key_lies_in_several_ranges(spark):
    rows = [("hot", i, START + timedelta(seconds=i)) for i in range(500)] + [("other", 900, START)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    dealt = ordered.ranged(df, [F.col(c) for c in ("key", "ts", "event_id")], 5)
    assert dealt.filter("key = 'hot'").select(ordered.RANGE).distinct().count() >= 4
