"""The named queries over the driver's tables, each with the same in DuckDB's SQL where SQL has it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import calendar, values
from .operators import aggregates, filters, limits, lookups, merge, ordered, paging
from .plans import activity, catalog, collections, dashboard
from .registry import AS_OF, ORACLES, QUERIES, Tables, query
from .streaming import keyed

# Dashboards: A1 to A13, Q14 to Q18, T9


@query("""WITH a AS (SELECT count(*) AS user_count, count(*) FILTER (created_at >= DATE '2024-01-20') AS today_new_users FROM account),
    c AS (SELECT count(*) AS collection_count, count(*) FILTER (created_at >= DATE '2024-01-20') AS today_new_collections FROM user_collection),
    l AS (SELECT count(*) FILTER (action = 'LOGIN' AND status = 0 AND created_at >= DATE '2024-01-20') AS today_logins FROM operation_log),
    s AS (SELECT count(*) AS subject_count FROM subject), e AS (SELECT count(*) AS episode_count FROM episode), i AS (SELECT count(*) AS import_count FROM import_record)
    SELECT * FROM a, c, l, s, e, i""")
def overview(t: Tables) -> DataFrame:
    return dashboard.overview(t.spark, t.account, t.subject, t.user_collection, t.episode, t.import_record, t.operation_log, AS_OF)


@query("""SELECT d.day AS day, coalesce(u.n, 0) AS new_users, coalesce(c.n, 0) AS new_collections, coalesce(l.n, 0) AS logins
    FROM (SELECT CAST(unnest(range(DATE '2023-12-08', DATE '2024-02-06', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN (SELECT created_at AS day, count(*) AS n FROM account GROUP BY 1) u USING (day)
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM user_collection GROUP BY 1) c USING (day)
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM operation_log WHERE action = 'LOGIN' AND status = 0 GROUP BY 1) l USING (day)""")
def trends_gap_filled(t: Tables) -> DataFrame:
    return dashboard.trends(t.spark, t.account, t.user_collection, t.operation_log, date(2024, 2, 5), 60)


@query("""SELECT d.day AS day, coalesce(l.n, 0) AS logins, d.span AS span FROM (SELECT DATE '2024-01-20' AS day, 'none' AS span
      UNION ALL SELECT CAST(unnest(range(DATE '2023-10-23', DATE '2024-01-21', INTERVAL 1 DAY)) AS DATE), 'many') d
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM operation_log WHERE action = 'LOGIN' AND status = 0 GROUP BY 1) l USING (day)""")
def trends_clamped(t: Tables) -> DataFrame:
    asked = lambda n, name: aggregates.daily_trends(t.spark, {"logins": (dashboard.logins(t.operation_log), "created_at")}, AS_OF, n).withColumn("span", F.lit(name))
    return asked(0, "none").unionByName(asked(500, "many"))


@query("SELECT type, count(*) AS n FROM user_collection GROUP BY type")
def type_counts(t: Tables) -> DataFrame:
    return dashboard.collection_types(t.user_collection)


@query("SELECT rate, count(*) AS n FROM user_collection WHERE rate > 0 GROUP BY rate")
def rating_counts(t: Tables) -> DataFrame:
    return dashboard.ratings(t.user_collection)


@query("SELECT CAST(floor(score) AS INT) AS rate, count(*) AS n FROM subject WHERE score > 0 GROUP BY 1")
def score_histogram(t: Tables) -> DataFrame:
    return dashboard.scores(t.subject)


@query("""SELECT concat(year(o_orderdate), '-', CASE WHEN month(o_orderdate) <= 3 THEN 'winter' WHEN month(o_orderdate) <= 6 THEN 'spring' WHEN month(o_orderdate) <= 9 THEN 'summer' ELSE 'autumn' END) AS season_key,
    count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def season_counts(t: Tables) -> DataFrame:
    return aggregates.season_counts(t.raw("orders"), "o_orderdate")


@query("""SELECT concat(year(air_date), '-', CASE WHEN month(air_date) <= 3 THEN 'winter' WHEN month(air_date) <= 6 THEN 'spring' WHEN month(air_date) <= 9 THEN 'summer' ELSE 'autumn' END) AS season_key,
    count(*) AS n FROM subject WHERE air_date IS NOT NULL GROUP BY 1""")
def subject_seasons(t: Tables) -> DataFrame:
    return dashboard.seasons(t.subject)


@query("SELECT import_status, count(*) AS n FROM subject GROUP BY 1")
def import_states(t: Tables) -> DataFrame:
    return dashboard.import_states(t.subject)


@query("SELECT count(*) AS import_total, count(*) FILTER (status = 'COMPLETED') AS import_succeeded, count(*) FILTER (status = 'FAILED') AS import_failed FROM import_record")
def status_totals(t: Tables) -> DataFrame:
    return dashboard.import_totals(t.import_record)


LOG_STATS = """SELECT count(*) AS total, count(*) FILTER (status = 0) AS success_count, count(*) FILTER (status = 1) AS failed_count, coalesce(avg(duration_ms), 0.0) AS avg_duration_ms
    FROM operation_log WHERE """


@query(LOG_STATS + "action = 'VIEW' AND module = 'CLIENT' AND created_at >= DATE '2024-01-05' AND created_at < DATE '2024-01-16'")
def log_stats(t: Tables) -> DataFrame:
    return activity.log_stats(t.operation_log, action=" VIEW ", module="CLIENT", start=date(2024, 1, 5), end=date(2024, 1, 15))


@query(LOG_STATS + "username = 'nobody'")
def log_stats_empty(t: Tables) -> DataFrame:
    return activity.log_stats(t.operation_log, username="nobody")


@query("""SELECT s.id, s.name, s.name_cn, count(c.id) AS collection_count FROM user_collection c JOIN subject s ON c.subject_id = s.id GROUP BY s.id, s.name, s.name_cn
    ORDER BY collection_count DESC, s.id LIMIT 10""")
def hot_ranking(t: Tables) -> DataFrame:
    return dashboard.hot(t.user_collection, t.subject, 10)


@query("SELECT day, n FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM operation_log WHERE action = 'LOGIN' AND status = 0 AND created_at >= DATE '2024-01-20' GROUP BY 1)")
def logins_per_day(t: Tables) -> DataFrame:
    return aggregates.per_day(dashboard.logins(t.operation_log), "created_at", AS_OF)


# Catalog: Q1 to Q8, Q23

LIST = "s.id, s.name, s.name_cn, s.image, s.score, s.rank, s.eps, s.air_date, s.air_weekday, s.type, s.collection_total"


@query(f"SELECT {LIST}, (SELECT count(*) FROM subject) AS total FROM subject s ORDER BY s.rank ASC NULLS FIRST, s.id LIMIT 20 OFFSET 40")
def subject_list(t: Tables) -> DataFrame:
    return catalog.subjects(t.subject, 3, 20, "rank", "asc")


@query(f"""SELECT {LIST} FROM subject s JOIN subject_tag g ON g.subject_id = s.id AND g.name IN ('A', 'N') WHERE (lower(s.name) LIKE '%bolt%' OR lower(s.name_cn) LIKE '%bolt%')
    GROUP BY ALL HAVING count(DISTINCT g.name) = 2""")
def all_tags_search(t: Tables) -> DataFrame:
    return catalog.list_items(catalog.searched(t.subject, t.subject_tag, q="BOLT", tags=["A", "N", "A"]))


@query(f"""SELECT {LIST} FROM subject s WHERE (lower(s.name) LIKE '%ring%' OR lower(s.name_cn) LIKE '%ring%') AND s.score >= 2 AND s.score <= 9.5
    ORDER BY CASE WHEN lower(s.name_cn) LIKE '%ring%' THEN 0 ELSE 1 END, s.score DESC, s.id LIMIT 20 OFFSET 20""")
def search_ranked(t: Tables) -> DataFrame:
    return catalog.search(t.subject, None, 2, 20, q=" ring ", score_min=2, score_max=9.5)


@query(f"SELECT {LIST} FROM subject s WHERE lower(s.name) LIKE '%r_d%w%' OR lower(s.name_cn) LIKE '%r_d%w%'")
def search_wildcards(t: Tables) -> DataFrame:
    return catalog.list_items(catalog.searched(t.subject, q="r_d%w", wildcards=True))


@query(f"SELECT {LIST} FROM subject s WHERE s.air_date >= DATE '1997-01-01' AND s.air_date <= DATE '1997-12-31' AND s.air_weekday = 3 ORDER BY s.air_date ASC, s.id LIMIT 50")
def search_year_weekday(t: Tables) -> DataFrame:
    return catalog.search(t.subject, None, 1, 50, "date", "asc", year=1997, weekday=3)


@query(f"SELECT {LIST} FROM subject s WHERE s.air_date BETWEEN DATE '1998-07-01' AND DATE '1998-09-30' ORDER BY s.score DESC NULLS LAST, s.id LIMIT 100")
def by_season(t: Tables) -> DataFrame:
    return catalog.by_season(t.subject, 1998, "summer", 1, 500)


@query(f"SELECT {LIST} FROM subject s WHERE s.air_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' ORDER BY s.air_weekday ASC NULLS FIRST, s.score DESC NULLS LAST, s.id LIMIT 50")
def schedule(t: Tables) -> DataFrame:
    return catalog.schedule(t.subject, date(1996, 2, 29), weekday=-1, size=50)


@query("""SELECT s.id, s.name, (SELECT string_agg(concat(g.name, ':', g.count), ',' ORDER BY g.count DESC, g.name) FROM subject_tag g WHERE g.subject_id = s.id) AS tags,
    (SELECT string_agg(concat(r.relation, ':', o.id, ':', o.name, ':', o.name_cn), ',' ORDER BY o.id) FROM subject_relation r JOIN subject o ON o.id = r.related_subject_id WHERE r.subject_id = s.id) AS relations FROM subject s WHERE s.id = 7""")
def subject_detail(t: Tables) -> DataFrame:
    both = lookups.both_ways(t.subject_relation, "subject_id", "related_subject_id", "relation", values.inverse_relation)
    tags = F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"))), ",")
    relations = F.array_join(F.transform("relations", lambda x: F.concat_ws(":", x["relation"], x["id"].cast("string"), x["name"], x["name_cn"])), ",")
    own = both.filter(F.col("subject_id") < F.col("related_subject_id"))  # the edges as they are
    return catalog.detail(t.subject, t.subject_tag, own, 7).select("id", "name", tags.alias("tags"), F.nullif(relations, F.lit("")).alias("relations"))


@query("""SELECT id, subject_id, type, sort, CASE WHEN airdate < DATE '1998-06-01' THEN 'Air' WHEN airdate = DATE '1998-06-01' THEN 'Today' ELSE 'NA' END AS status,
    row_number() OVER (ORDER BY sort, id, airdate) AS place FROM (SELECT id, subject_id, type, sort, min(airdate) AS airdate FROM episode WHERE subject_id = 7 GROUP BY ALL)""")
def episode_list(t: Tables) -> DataFrame:
    own = t.episode.groupBy("id", "subject_id", "type", "sort").agg(F.min("airdate").alias("airdate"))
    return ordered.Numbered(catalog.episodes(own, 7, date(1998, 6, 1)).drop("airdate"), [F.col("sort"), F.col("id"), F.col("status")]).places()


@query("SELECT CAST(NULL AS BIGINT) AS id, name, count(*) AS count FROM subject_tag GROUP BY name")
def tag_counts(t: Tables) -> DataFrame:
    return catalog.tags(t.subject_tag)


@query(f"SELECT {LIST} FROM (SELECT id, subject_id FROM subject_tag WHERE name = 'R' ORDER BY id LIMIT 20 OFFSET 20) g JOIN subject s ON s.id = g.subject_id")
def by_tag_page(t: Tables) -> DataFrame:
    return catalog.subjects_by_tag(t.subject, t.subject_tag, "R", 2, 20)


@query(f"SELECT {LIST} FROM subject s ORDER BY s.collection_total DESC NULLS LAST, s.id LIMIT 10")
def popular(t: Tables) -> DataFrame:
    return catalog.popular(t.subject)


@query(f"SELECT {LIST} FROM subject s ORDER BY s.score DESC NULLS LAST, s.id LIMIT 10")
def top_rated(t: Tables) -> DataFrame:
    return catalog.top_rated(t.subject)


@query("SELECT i.position, i.place, s.id, s.name FROM (VALUES (0, 1, 5), (1, 2, 3), (2, 3, 11)) i(position, place, id) JOIN subject s ON s.id = i.id")
def multi_get(t: Tables) -> DataFrame:
    wanted = lookups.in_given_order(t.subject.select("id", "name"), "id", [5, 3, 5, 11, 10**9], numbered=True)
    return paging.numbered(wanted).select("position", "place", "id", "name")


@query("SELECT id, name FROM subject WHERE id = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.subject.filter(F.col("id") == 42).select("id", "name")


# Collections: Q9 to Q13, Q22


@query("""SELECT c.subject_id, c.id, c.user_id, c.type, c.rate, c.ep_status, c.created_at, c.updated_at, s.name, s.name_cn, s.image, s.score, s.eps, s.air_date, s.air_weekday, s.type AS subject_type
    FROM user_collection c JOIN subject s ON s.id = c.subject_id WHERE c.type = 3 ORDER BY c.updated_at DESC, c.id DESC LIMIT 20 OFFSET 20""")
def collection_page(t: Tables) -> DataFrame:
    return collections.collections(t.user_collection, t.subject, kind=3, number=2)


@query("SELECT user_id, type, count(*) AS n FROM user_collection GROUP BY 1, 2")
def user_type_counts(t: Tables) -> DataFrame:
    return collections.type_counts(t.user_collection).select("user_id", F.explode("counts").alias("type", "n"))


@query("""SELECT c.subject_id, c.id, c.user_id, c.type, c.rate, c.ep_status, c.created_at, c.updated_at, s.name, s.name_cn, s.image, s.score, s.eps, s.air_date, s.air_weekday, s.type AS subject_type
    FROM user_collection c JOIN subject s ON s.id = c.subject_id WHERE c.user_id = 8 AND s.air_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'
    ORDER BY s.air_weekday, s.score DESC NULLS LAST, c.id LIMIT 20""")
def my_schedule(t: Tables) -> DataFrame:
    return collections.schedule(t.user_collection, t.subject, AS_OF, 8, year=1995, season="winter")


@query("SELECT id, user_id, subject_id, type, rate, ep_status FROM user_collection WHERE user_id = 8 AND subject_id = 7")
def one_collection(t: Tables) -> DataFrame:
    return collections.one(t.user_collection, 8, 7).select("id", "user_id", "subject_id", "type", "rate", "ep_status")


@query("""WITH aired AS (SELECT subject_id, CAST(max(sort) AS INT) AS target_ep_status FROM episode WHERE sort = floor(sort) AND type = 0 AND airdate >= DATE '1998-03-02' AND airdate < DATE '1998-03-06' GROUP BY subject_id),
    watched AS (SELECT user_id, subject_id, ep_status AS current_ep_status FROM user_collection WHERE type = 3),
    shown AS (SELECT id AS subject_id, CASE WHEN name_cn <> '' THEN name_cn ELSE name END AS subject_name, eps AS total_episodes FROM subject)
    SELECT *, total_episodes > 0 AND target_ep_status >= total_episodes AS completed FROM watched JOIN aired USING (subject_id) JOIN shown USING (subject_id) WHERE target_ep_status > current_ep_status""")
def progress_candidates(t: Tables) -> DataFrame:
    return collections.progress_candidates(t.user_collection, t.subject, t.episode, date(1998, 3, 6))


@query("""SELECT c.subject_id, coalesce(nullif(s.name, ''), s.name_cn) AS name, CASE c.type WHEN 1 THEN 'wish' WHEN 2 THEN 'watched' WHEN 3 THEN 'watching' WHEN 4 THEN 'on hold' WHEN 5 THEN 'dropped' END AS type,
    nullif(c.rate, 0) AS rate, c.ep_status, c.updated_at, c.id FROM user_collection c JOIN subject s ON s.id = c.subject_id WHERE c.user_id = 8 ORDER BY c.updated_at DESC, c.id DESC LIMIT 5""")
def watch_profile(t: Tables) -> DataFrame:
    return collections.watch_profile(t.user_collection, t.subject, 8, 5)


# Activity: Q19 to Q21, Q24


@query("SELECT id, user_id, username, action, module, status, duration_ms, params, created_at FROM operation_log WHERE status = 1 AND created_at >= DATE '2024-01-10' ORDER BY id DESC LIMIT 20 OFFSET 20")
def log_page(t: Tables) -> DataFrame:
    return activity.logs(t.operation_log, 2, 20, status=1, start=date(2024, 1, 10))


@query("SELECT id, username, email, nickname, role, created_at FROM account ORDER BY created_at DESC, id DESC LIMIT 20")
def user_page(t: Tables) -> DataFrame:
    return activity.users(t.account)


@query("SELECT id, username, email, nickname, role, created_at FROM account WHERE username = 'customer#000000009@example.com' OR email = 'customer#000000009@example.com' OR email = username")
def account_lookup(t: Tables) -> DataFrame:
    return activity.account(t.account, "customer#000000009@example.com")


@query("SELECT id, mode, started_at, completed_at, status, subject_count FROM import_record WHERE status = 'FAILED' ORDER BY started_at DESC, id DESC LIMIT 20")
def import_records(t: Tables) -> DataFrame:
    return activity.import_records(t.import_record, "FAILED")


@query("""SELECT count(*) AS import_total, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS import_succeeded, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS import_failed,
    max(completed_at) AS last_completed_at FROM import_record""")
def import_status(t: Tables) -> DataFrame:
    return activity.import_status(t.import_record)[0]


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
    SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS message_count, substr(max(CASE WHEN role = 'user' AND n = 1 THEN text END), 1, 20) AS title FROM m GROUP BY conv_id""")
def session_summary(t: Tables) -> DataFrame:
    return activity.sessions(t.raw("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")))


@query("SELECT turn, role, text AS content FROM conversations WHERE conv_id = 3")
def session_history(t: Tables) -> DataFrame:
    return activity.history(t.raw("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")), 3).drop("session_id")


@query("SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS event_type FROM events GROUP BY user_id")
def last_events(t: Tables) -> DataFrame:
    return activity.last_event(t.raw("events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "event_type")


@query("""SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS reply,
    (SELECT string_agg(tool, ',' ORDER BY first) FROM (SELECT event_type AS tool, min(event_id) AS first FROM events i WHERE i.user_id = e.user_id AND event_type <> 'view' GROUP BY 1)) AS tools FROM events e GROUP BY user_id""")
def reply_text(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("delta"), F.nullif("event_type", F.lit("view")).alias("tool"))
    return activity.replies(rows).select(F.col("request_id").alias("user_id"), "reply", F.nullif(F.array_join("tools", ","), F.lit("")).alias("tools"))


@query("""SELECT user_id, CAST(date_diff('millisecond', min(ts), min(CASE WHEN event_type = 'view' THEN ts END)) AS BIGINT) AS first_token_ms, CAST(date_diff('millisecond', min(ts), max(ts)) AS BIGINT) AS duration_ms
    FROM (SELECT user_id, event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id""")
def request_metrics(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("request_id"), "event_type", F.date_trunc("second", "ts").alias("ts"))
    return activity.request_metrics(rows, token="view").withColumnRenamed("request_id", "user_id")


# State changes: W1 to W16, D1 to D5, J8 to J12

@query("""SELECT p_partkey, p_name, p_size FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey < 100) b
    UNION ALL SELECT p_partkey + 100, p_name, p_size + 1 FROM part""")
def upsert(t: Tables) -> DataFrame:
    part = t.raw("part").select("p_partkey", "p_name", "p_size")
    return merge.upsert(part, part.select((F.col("p_partkey") + 100).alias("p_partkey"), "p_name", (F.col("p_size") + 1).alias("p_size")), ["p_partkey"], unique=True)


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS p_size FROM part")
def partial_update(t: Tables) -> DataFrame:
    part = t.raw("part").select("p_partkey", "p_name", "p_size")
    change = part.select("p_partkey", F.lit(None).cast("string").alias("p_name"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size") + 1).alias("p_size"))
    return merge.upsert(part, change, ["p_partkey"], partial=True, unique=True)


@query("""SELECT id, CASE WHEN id % 3 = 2 THEN 'failed' WHEN id % 3 = 1 OR type <> 3 THEN 'skipped' ELSE 'succeeded' END AS outcome FROM user_collection""")
def cas_update(t: Tables) -> DataFrame:
    own = t.user_collection
    key = F.when(F.col("id") % 3 == 2, -F.col("id") - 1).otherwise(F.col("id"))
    changes = own.select(key.alias("id"), F.when(F.col("id") % 3 == 1, -1).otherwise(F.col("ep_status")).alias("expected"), (F.col("ep_status") + 1).alias("target"))
    judged = merge.compare_and_set(own.select("id", "type", "ep_status"), changes, ["id"], "ep_status", unless=F.col("type") != 3)[1]
    return judged.select(F.when(F.col("id") < 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), "outcome")


@query("""SELECT id, CASE WHEN id % 3 = 2 OR id % 3 = 1 THEN ep_status ELSE ep_status + 1 END AS ep_status FROM user_collection""")
def cas_result(t: Tables) -> DataFrame:
    own = t.user_collection.select("id", "ep_status")
    changes = own.filter("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 1, -1).otherwise(F.col("ep_status")).alias("expected"), (F.col("ep_status") + 1).alias("target"))
    return merge.compare_and_set(own, changes, ["id"], "ep_status")[0]


@query("""SELECT a.id AS user_id, CASE WHEN c.id IS NULL THEN 'ADDED' ELSE 'ALREADY_COLLECTED' END AS outcome, CAST(c.type AS INT) AS existing FROM account a
    LEFT JOIN (SELECT user_id AS id, min(type) AS type FROM user_collection WHERE type >= 4 GROUP BY 1) c ON c.id = a.id""")
def insert_if_absent(t: Tables) -> DataFrame:
    own = t.user_collection.filter("type >= 4").groupBy("user_id").agg(F.min("type").alias("type"))
    return merge.insert_absent(own, t.account.select(F.col("id").alias("user_id"), F.lit(1).alias("type")), ["user_id"], "type")[1]


@query("SELECT id AS user_id FROM account WHERE id NOT IN (SELECT user_id FROM user_collection WHERE type = 1)")
def not_collected(t: Tables) -> DataFrame:
    return lookups.split_known(t.account.select(F.col("id").alias("user_id")), t.user_collection.filter("type = 1").select("user_id").distinct(), ["user_id"])[0]


@query("""SELECT id, CASE WHEN id % 2 = 1 AND id % 4 = 1 THEN 'INSERTED' WHEN id % 3 = 0 THEN 'CONFLICT' ELSE 'UPDATED' END AS outcome FROM user_collection""")
def save_outcomes(t: Tables) -> DataFrame:
    own = t.user_collection.select("id", "rate", "ep_status")
    rows = own.select("id", F.when(F.col("id") % 3 == 0, F.col("rate")).otherwise(F.col("rate") + 1).alias("rate"), "ep_status")
    return merge.save_or_conflict(own.filter("NOT (id % 2 = 1 AND id % 4 = 1)"), rows, ["id"], ["rate", "ep_status"]).select("id", "outcome")


@query("SELECT id FROM user_collection WHERE NOT (user_id % 7 = 0)")
def delete_by_key(t: Tables) -> DataFrame:
    own = t.user_collection.select("id", "user_id")
    return merge.delete(own, own.filter("user_id % 7 = 0").select("user_id").distinct(), ["user_id"]).select("id")


@query("SELECT id, created_at FROM operation_log WHERE created_at >= DATE '2024-01-20'")
def retention(t: Tables) -> DataFrame:
    return merge.retained(t.operation_log.select("id", "created_at"), "created_at", date(2024, 1, 30), 10)


@query("SELECT id, CASE WHEN status = 'RUNNING' AND id % 2 = 0 THEN 'FAILED' ELSE status END AS status FROM import_record")
def swept_jobs(t: Tables) -> DataFrame:
    jobs = t.import_record.withColumn("error_message", F.lit(None).cast("string"))
    return merge.swept(jobs, jobs.filter("id % 2 = 1").select("id"), F.lit("2024-02-01").cast("timestamp_ntz")).select("id", "status")


@query("""SELECT subject_id, related_subject_id, relation FROM subject_relation UNION ALL
    SELECT related_subject_id, subject_id, CASE relation WHEN 'prequel' THEN 'sequel' WHEN 'spin_off' THEN 'parent_story' WHEN 'side_story' THEN 'parent_story' ELSE relation END FROM subject_relation""")
def edges_bidirectional(t: Tables) -> DataFrame:
    return lookups.both_ways(t.subject_relation, "subject_id", "related_subject_id", "relation", values.inverse_relation)


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_seen(t: Tables) -> DataFrame:
    return paging.first_seen(t.raw("documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT id, coalesce(nullif(name_cn, ''), name) AS display_name FROM subject")
def display_name(t: Tables) -> DataFrame:
    return t.subject.select("id", values.display_name(F.col("name_cn"), F.col("name")).alias("display_name"))


@query("""SELECT id, eps, 'left' AS side FROM subject WHERE eps % 7 = 0 UNION ALL SELECT id, eps + 1, 'right' FROM subject WHERE eps % 7 = 0""")
def list_differences(t: Tables) -> DataFrame:
    """All subjects against a list in which some have one episode more."""
    own = t.subject.select("id", "eps")
    return lookups.differences(own, own.withColumn("eps", F.when(F.col("eps") % 7 == 0, F.col("eps") + 1).otherwise(F.col("eps"))))


@query("SELECT user_id, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM operation_log GROUP BY user_id")
def distinct_values(t: Tables) -> DataFrame:
    return t.operation_log.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


@query("SELECT c.id, s.name FROM user_collection c JOIN subject s ON s.id = c.subject_id WHERE s.nsfw = false AND c.rate > 5")
def joined_filtered(t: Tables) -> DataFrame:
    shown = t.subject.filter(filters.safe_for_all(F.col("nsfw"))).select(F.col("id").alias("subject_id"), "name")
    return t.user_collection.filter("rate > 5").select("id", "subject_id").join(shown, "subject_id").select("id", "name")


# Functions: P8 to P12, X1 to X32


@query("""SELECT id, CASE WHEN air_date < DATE '1998-01-01' THEN 'Air' WHEN air_date = DATE '1998-01-01' THEN 'Today' ELSE 'NA' END AS status, air_weekday AS weekday,
    CASE WHEN air_weekday IS NULL THEN NULL ELSE CAST((air_weekday + 6) % 7 AS INT) END AS monday_first FROM subject""")
def calendar_functions(t: Tables) -> DataFrame:
    day = F.col("air_date")
    return t.subject.select(
        "id", calendar.airing_status(day, date(1998, 1, 1)).alias("status"), calendar.weekday(day).alias("weekday"), calendar.monday_first(calendar.weekday(day)).cast("int").alias("monday_first")
    )


@query(r"""SELECT event_id, substr(sha256(concat('pepper:', event_type)), 1, 16) AS hashed,
    concat('{"password" : "***","note":"', event_type, '","code":"***","k":', event_id, CASE WHEN event_id % 2 = 0 THEN ',"oldPassword":null}' ELSE ',"newPassword":"***"}' END) AS masked,
    CASE WHEN s >= 3600 THEN concat(s // 3600, 'h', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), 'm', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 's') ELSE concat(s // 60, 'm', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 's') END AS took,
    nullif(greatest(CAST(floor(value) AS INT), 0), 0) AS most FROM (SELECT *, CAST(floor(value * 97) AS BIGINT) AS s FROM events)""")
def text_functions(t: Tables) -> DataFrame:
    """Secrets hold escaped quotes and commas; durations go beyond an hour."""
    last = F.when(F.col("event_id") % 2 == 0, ',"oldPassword":null}').otherwise(',"newPassword":"a\\\\"}')
    params = F.concat(F.lit('{"password" : "a\\"b, c","note":"'), "event_type", F.lit('","code":"","k":'), F.col("event_id").cast("string"), last)
    return t.raw("events").select(
        "event_id", values.salted_hash(F.col("event_type"), "pepper").alias("hashed"), values.masked_json(params).alias("masked"), values.duration(F.col("value") * 97).alias("took"),
        values.positive_max(F.floor("value").cast("int"), F.lit(None).cast("int")).alias("most"),
    )


# State for each key: R2 to R4, and the same functions on streams in streaming.keyed


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, event_id, ts, n, ts AS opened, 1 AS hits FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.ts, e.n, CASE WHEN e.ts >= s.opened + INTERVAL 1 DAY THEN e.ts ELSE s.opened END, CASE WHEN e.ts >= s.opened + INTERVAL 1 DAY THEN 1 ELSE s.hits + 1 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(hits AS BIGINT) AS hits, hits <= 2 AS allowed FROM s""")
def rate_windows(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", F.lit(True).alias("success"))
    return limits.limited_table(rows, limits.Rule(2, 86_400)).select("key", "event_id", "hits", "allowed")


@query("SELECT user_id, max(ts) AS created_at FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 600 SECOND AND ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id")
def alive_snapshots(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    rows = t.raw("events").select("user_id", F.col("ts").alias("created_at")).filter(F.col("created_at") <= as_of)
    return keyed.latest_alive(rows, "user_id", as_of).select("user_id", "snapshot.created_at")


from . import feed_queries, layout_queries, state_queries  # noqa: E402, F401  these register theirs
