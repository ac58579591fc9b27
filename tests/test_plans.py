"""Edge rows that the driver's tables lack: nulls, ties, empty inputs, bounds; and the state changes."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from watchshelf.functions import calendar, values
from watchshelf.operators import filters, lookups, merge, paging
from watchshelf.plans import activity, catalog, collections, dashboard, ingestion
from watchshelf.sources import readers

SUBJECT = "id long, name string, name_cn string, image string, score decimal(3,1), rank int, eps int, air_date date, air_weekday int, type int, collection_total int"


def subjects(spark, *rows):
    return spark.createDataFrame([(i, n, c, None, s and Decimal(s), None, e, d, w, 2, None) for i, n, c, s, e, d, w in rows], SUBJECT)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_nulls_sort_first_up_and_last_down(spark):
    s = subjects(spark, (1, "a", "", None, 1, None, None), (2, "b", "", "5.0", 1, None, None), (3, "c", "", "5.0", 1, None, None))
    assert ids(catalog.subjects(s, sort="score", direction="asc")) == [1, 2, 3]
    assert ids(catalog.subjects(s, sort="score", direction="desc")) == [2, 3, 1]
    assert ids(catalog.subjects(s, sort="; drop table", direction="up")) == [2, 3, 1]
    assert catalog.subjects(s, 999).collect() == []


def test_seasons_and_weekdays(spark):
    assert calendar.season_range(2024, "winter") == (date(2024, 1, 1), date(2024, 3, 31))
    assert calendar.season_range(2024, "autumn") == (date(2024, 10, 1), date(2024, 12, 31))
    assert calendar.parse_season("2026-Summer") == (2026, "summer")
    assert calendar.parse_season("2026-summer", calendar.FEED_SEASONS) == (2026, "spring")
    with pytest.raises(ValueError):
        calendar.parse_season("2026")
    s = subjects(spark, (1, "a", "", None, 1, date(2024, 3, 31), 0), (2, "b", "", None, 1, date(2024, 4, 1), 1), (3, "c", "", None, 1, date(2024, 12, 31), 2), (4, "d", "", None, 1, None, None))
    assert {r.season_key: r.n for r in dashboard.seasons(s).collect()} == {"2024-winter": 1, "2024-spring": 1, "2024-autumn": 1}
    assert ids(catalog.by_season(s, 2024, "winter")) == [1]
    assert ids(catalog.schedule(s, date(2024, 5, 5), weekday=1)) == [2]
    week = s.select(calendar.weekday(F.lit(date(2024, 8, 18))).alias("w"), calendar.monday_first(F.lit(0)).alias("m")).first()
    assert (week.w, week.m) == (0, 6)


def test_search(spark):
    s = subjects(spark, (1, "Alpha 100%", "", "7.0", 1, None, None), (2, "beta", "ALPHA", "6.0", 1, None, None), (3, "a\\x", None, None, 1, None, None), (4, "100 percent", "", "8.0", 1, None, None))
    tag = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "x")], "subject_id long, name string")
    assert ids(catalog.search(s, q="alpha")) == [2, 1]
    assert sorted(ids(catalog.search(s, q="100%"))) == [1]
    assert sorted(ids(catalog.search(s, q="100%", wildcards=True))) == [1, 4]
    assert ids(catalog.search(s, q="A\\X")) == [3] and ids(catalog.search(s, q="a\\x", wildcards=True)) == [3]
    assert ids(catalog.search(s, tag, tags=["x", "y", "x"])) == [1]
    assert len(ids(catalog.search(s, tag, q="  "))) == 4
    with pytest.raises(ValueError):
        catalog.search(s, score_min=11)


def test_progress(spark):
    s = subjects(spark, (1, "A", "", None, 12, None, None), (2, "B", "", None, 6, None, None), (3, "C", "", None, 3, None, None))
    episode = spark.createDataFrame(
        [(1, 0, Decimal("5.0"), date(2026, 8, 11)), (1, 0, Decimal("12.5"), date(2026, 8, 11)), (2, 0, Decimal("6.0"), date(2026, 8, 13)), (3, 0, Decimal("1.5"), date(2026, 8, 12)), (1, 1, Decimal("9.0"), date(2026, 8, 12))],
        "subject_id long, type int, sort decimal(5,1), airdate date",
    )
    own = lambda *steps: spark.createDataFrame([(i, 1, sid, 3, 0, ep) for i, (sid, ep) in enumerate(steps)], "id long, user_id long, subject_id long, type int, rate int, ep_status int")
    found = collections.progress_candidates(own((1, 3), (2, 6), (3, 0)), s, episode, date(2026, 8, 15)).collect()
    assert [(r.subject_id, r.subject_name, r.current_ep_status, r.target_ep_status, r.completed) for r in found] == [(1, "A", 3, 5, False)]
    found = collections.progress_candidates(own((2, None)), s, episode, date(2026, 8, 15)).collect()
    assert [(r.subject_id, r.completed) for r in found] == [(2, True)]
    assert calendar.week_so_far(date(2026, 8, 15)) == (date(2026, 8, 10), date(2026, 8, 14))
    assert collections.progress_candidates(own((1, 3)), s, episode, date(2026, 8, 10)).collect() == []


def test_log_filters_share_their_bounds(spark):
    at = [datetime(2026, 7, 31, 23, 59, 59), datetime(2026, 8, 1), datetime(2026, 8, 10, 23, 59, 59), datetime(2026, 8, 11)]
    log = spark.createDataFrame([(i, 1, "u", "LOGIN", "CLIENT", 0, 10, t) for i, t in enumerate(at)], "id long, user_id long, username string, action string, module string, status int, duration_ms long, created_at timestamp_ntz")
    span = {"start": date(2026, 8, 1), "end": date(2026, 8, 10)}
    assert ids(activity.logs(log, **span)) == [2, 1]
    assert activity.log_stats(log, **span).first().total == 2
    empty = activity.log_stats(log, username="x").first()
    assert tuple(empty) == (0, 0, 0, 0.0)
    assert len(filters.log_conditions()) == 5
    assert ids(activity.logs(log)) == [3, 2, 1, 0]


def test_trends_are_clamped_and_dense(spark):
    none = spark.createDataFrame([], "created_at timestamp_ntz")
    log = none.select(F.lit("LOGIN").alias("action"), F.lit(0).alias("status"), "created_at")
    for asked, rows in ((0, 1), (500, 90), (30, 30)):
        found = dashboard.trends(spark, none, none, log, date(2026, 8, 15), asked).collect()
        assert len(found) == rows and all(r.new_users == r.new_collections == r.logins == 0 for r in found)


def test_upsert_keeps_what_was_created(spark):
    base = spark.createDataFrame([(1, 10, "old", datetime(2020, 1, 1)), (2, 20, "stays", datetime(2020, 1, 1))], "id long, bangumi_id int, name string, created_at timestamp_ntz")
    fresh = spark.createDataFrame([(7, 10, None, datetime(2026, 1, 1)), (8, 30, "new", datetime(2026, 1, 1))], "id long, bangumi_id int, name string, created_at timestamp_ntz")
    found = {r.bangumi_id: tuple(r) for r in ingestion.merged_subjects(base, fresh).collect()}
    assert found == {10: (1, 10, None, datetime(2020, 1, 1)), 20: (2, 20, "stays", datetime(2020, 1, 1)), 30: (8, 30, "new", datetime(2026, 1, 1))}


def test_wish_and_execution_outcomes(spark):
    own = spark.createDataFrame([(1, 5, 3, 2), (1, 6, 3, 4)], "user_id long, subject_id long, type int, ep_status int")
    base, report = merge.insert_absent(own, spark.createDataFrame([(1, 5, 1), (1, 9, 1)], "user_id long, subject_id long, type int"), ["user_id", "subject_id"], "type")
    assert {r.subject_id: (r.outcome, r.existing) for r in report.collect()} == {5: ("ALREADY_COLLECTED", 3), 9: ("ADDED", None)} and base.count() == 3
    asked = spark.createDataFrame([(1, 5, 1, 3), (1, 7, 0, 1), (1, 6, 4, 6)], "user_id long, subject_id long, expected int, target int")
    after, judged = merge.compare_and_set(own, asked, ["user_id", "subject_id"], "ep_status")
    assert {r.outcome: list(r.ids) for r in merge.outcomes(judged, "subject_id").collect()} == {"skipped": [5], "failed": [7], "succeeded": [6]}
    assert {r.subject_id: r.ep_status for r in after.collect()} == {5: 2, 6: 6}
    saved = merge.save_or_conflict(own, spark.createDataFrame([(1, 5, 3, 2), (1, 6, 3, 5), (2, 5, 1, 0)], own.schema), ["user_id", "subject_id"], ["type", "ep_status"])
    assert {(r.user_id, r.subject_id): r.outcome for r in saved.collect()} == {(1, 5): "CONFLICT", (1, 6): "UPDATED", (2, 5): "INSERTED"}


def test_preview_states(spark):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    state = lambda status, changed=False, now="2026-01-01 00:05:00": spark.range(1).select(merge.preview_state(status, at("2026-01-01 00:10:00"), at(now), changed)).first()[0]
    assert [state("COMPLETED"), state("PENDING"), state("PENDING", True), state("FAILED"), state("PENDING", now="2026-01-01 00:10:00")] == ["REPLAY", "EXECUTE", "STALE", "INVALID", "INVALID"]
    schema = "subject_id long, name string, current_ep_status int, target_ep_status int"
    before = spark.createDataFrame([(1, "A", 3, 5)], schema)
    assert merge.preview_changes(before, spark.createDataFrame([(1, "renamed", 3, 5)], schema)).isEmpty()
    assert merge.preview_changes(before, spark.createDataFrame([(1, "A", 3, 6)], schema)).count() == 2


def test_relations_are_replaced_both_ways(spark):
    edge = "subject_id long, related_subject_id long, relation string"
    base = spark.createDataFrame([(1, 2, "sequel"), (2, 1, "prequel"), (3, 4, "character")], edge)
    feed = spark.createDataFrame([(1, 30, 2, "spin_off"), (1, 99, 2, "sequel"), (1, 40, 1, "book")], "subject_id long, id int, type int, relation string")
    subject = spark.createDataFrame([(3, 30), (4, 40)], "id long, bangumi_id int")
    after, missing = ingestion.merged_relations(base, feed, subject)
    assert sorted(map(tuple, after.collect())) == [(1, 3, "spin_off"), (3, 1, "parent_story"), (3, 4, "character")]
    assert [r.bangumi_id for r in missing.collect()] == [99]


def test_deletes_cascade(spark):
    base, gone = spark.range(4).toDF("id"), spark.createDataFrame([(1,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "subject_id long, related_subject_id long")
    left, children = merge.delete_cascading(base, gone, "id", {"subject_relation": (edges, ["subject_id", "related_subject_id"])})
    assert sorted(ids(left)) == [0, 2, 3] and [tuple(r) for r in children["subject_relation"].select("subject_id", "related_subject_id").collect()] == [(2, 3)]


def test_feeds_are_cleaned(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(
        '{"id":1,"name":"A","type":2,"eps":0,"total_episodes":12,"date":"2024年1月2日","nsfw":false,"rating":{"score":7.5,"rank":3},"tags":[{"name":"x","count":1},{"name":"x","count":4}]}\n'
        '{"id":2,"name":"B","nsfw":true}\n{"id":3,"date":"garbage"}\nnot json\n{"id":4,"date":""}\n'
    )
    feed = readers.landed(spark, str(tmp_path / "s"), "subject").filter("id IS NOT NULL")
    found = {r.bangumi_id: r for r in ingestion.clean_subjects(feed).collect()}
    assert sorted(found) == [1, 3, 4]
    assert (found[1].air_date, found[1].air_weekday, found[1].eps, found[1].score) == (date(2024, 1, 2), 2, 12, Decimal("7.5"))
    assert found[3].air_date is None and found[4].air_date is None and found[3].eps is None and found[3].name == ""
    assert [tuple(r) for r in ingestion.clean_tags(feed).collect()] == [(1, "x", 4)]
    assert sorted(ids(ingestion.clean_subjects(feed, "2024"), "bangumi_id")) == [1, 3]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/p.json").write_text('{"data":[{"id":5,"date":"2024-01-02"},{"id":6}],"total":2}\n')
    assert ids(readers.landed_browse(spark, str(tmp_path / "b")), "bangumi_id") == [5, 6]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/p.json").write_text('{"items":[{"id":5},{"id":6}]}\n{"items":[{"id":5}]}\n')
    days = readers.landed_calendar(spark, str(tmp_path / "c")).withColumn("at", F.struct("day", "place"))
    assert sorted(ids(paging.first_seen(days.select("bangumi_id", "at"), "bangumi_id", "at"), "bangumi_id")) == [5, 6]
    with pytest.raises(ValueError):
        readers.conform(feed, "subject")


def test_values(spark):
    row = spark.range(1).select(
        values.display_name(F.lit(""), F.lit("o")).alias("a"), values.masked_json(F.lit('{"password": "x", "a": "b"}')).alias("b"), values.duration(F.lit(3723)).alias("c"), values.duration(F.lit(5)).alias("d"),
        values.url_extension(F.lit("https://h/p/a.JPG?x=1.png")).alias("e"), values.url_extension(F.lit("https://h/p/a.exe")).alias("f"), values.is_safe_id(F.lit("a b")).alias("g"), values.salted_hash(F.lit(""), "s").alias("h"),
        values.error_kind(F.lit("TimeoutError")).alias("i"), values.label(F.lit(3), values.COLLECTION_TYPES).alias("j"), values.merged_unique(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("k"),
    ).first()
    assert tuple(row) == ("o", '{"password": "***", "a": "b"}', "1h02m03s", "0m05s", "jpg", None, False, None, "MODEL_TIMEOUT", "watching", ["b", "a", "c"])


def test_order_preserving_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert ids(lookups.in_given_order(df, "id", [2, 9, 1, 2])) == [2, 1]
    links = spark.createDataFrame([(0, 2), (1, 2), (2, 7)], "position int, subject_id long")
    assert ids(lookups.ordered_lookup(links, df, "subject_id", "id", "position")) == [2, 2]
    wished = collections.wishlist_plan(spark.createDataFrame([(0, 4), (1, 5), (2, 4)], "position int, subject_id long"), spark.createDataFrame([(1, 5)], "user_id long, subject_id long"), 1)
    assert [(r.subject_id, r.state) for r in wished.collect()] == [(4, "pending"), (5, "skipped")]


def test_accounts_never_show_a_password(spark):
    users = spark.createDataFrame([(1, "u", "u@x", "s")], "id long, username string, email string, password string").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    assert "password" not in activity.users(users).columns and "password" not in activity.account(users, "u@x").columns


def test_replies_and_sessions(spark):
    deltas = spark.createDataFrame([("r", 2, "b", "t2"), ("r", 1, "a", "t1"), ("r", 3, None, "t1")], "request_id string, seq int, delta string, tool string")
    assert [tuple(r) for r in activity.replies(deltas).collect()] == [("r", "ab", ["t1", "t2"])]
    messages = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "x" * 30), (1, 2, "assistant", "y"), (2, 0, "system", "s")], "session_id long, turn long, role string, content string")
    assert {r.session_id: (r.message_count, r.title) for r in activity.sessions(messages).collect()} == {1: (1, "x" * 20), 2: (0, None)}
