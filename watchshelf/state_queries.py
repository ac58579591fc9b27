"""Queries of state changes, previews, sessions and keyed state that the main list lacks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.collation import binary, ignoring_case
from .operators import filters, keywords, ledger, limits, merge, ordered, paging
from .plans import activity, catalog, collections
from .registry import Tables, query
from .sources.scratch import fresh_path, written
from .streaming import counters, keyed, previews


@query("SELECT session_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, session_id) + 5 AS place FROM (SELECT DISTINCT conv_id AS session_id, DATE '2024-01-01' + CAST(conv_id % 9 AS INT) AS updated_at FROM conversations WHERE conv_id % 3 = 1 ORDER BY updated_at DESC, session_id LIMIT 5 OFFSET 5)")
def newest_sessions(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 9).cast("int"))
    rows = t.raw("conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3).alias("user_id"), day.alias("updated_at")).distinct()
    return paging.numbered(activity.newest_sessions(rows, 1, number=2, size=5)).select("session_id", "updated_at", (F.col("place") + 5).alias("place"))


@query("""SELECT i.position, i.subject_id, CASE WHEN EXISTS (SELECT 1 FROM user_collection c WHERE c.user_id = 8 AND c.subject_id = i.subject_id) THEN 'skipped' ELSE 'pending' END AS state
    FROM (SELECT subject_id, min(position) AS position FROM (SELECT o_orderkey AS position, (o_orderkey * 7) % 200 AS subject_id FROM orders) GROUP BY 1 ORDER BY 2 LIMIT 10) i""")
def wishlist(t: Tables) -> DataFrame:
    asked = t.user_collection.select(F.col("id").alias("position"), "subject_id")
    return collections.wishlist_plan(asked, t.user_collection, 8).select("position", "subject_id", "state")


@query("""WITH s AS (SELECT * FROM (VALUES ('PENDING', true), ('PENDING', false), ('COMPLETED', true), ('CANCELLED', false)) v(status, changed))
    SELECT id, s.status, s.changed, CASE WHEN s.status = 'COMPLETED' THEN 'REPLAY' WHEN s.status <> 'PENDING' OR created_at <= DATE '1998-01-01' THEN 'INVALID' WHEN s.changed THEN 'STALE' ELSE 'EXECUTE' END AS state FROM user_collection, s""")
def preview_states(t: Tables) -> DataFrame:
    as_of, out = F.lit("1998-01-01").cast("timestamp_ntz"), None
    for status, changed in (("PENDING", True), ("PENDING", False), ("COMPLETED", True), ("CANCELLED", False)):
        part = t.user_collection.select("id", F.lit(status).alias("status"), F.lit(changed).alias("changed"), merge.preview_state(status, F.col("created_at"), as_of, changed).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT subject_id, current_ep_status, target_ep_status, side FROM (
      SELECT id AS subject_id, ep_status AS current_ep_status, 20 AS target_ep_status, 'left' AS side FROM user_collection WHERE id % 10 = 0
      UNION ALL SELECT id, ep_status, 21, 'right' FROM user_collection WHERE id % 10 = 0)""")
def preview_changes(t: Tables) -> DataFrame:
    shown = t.user_collection.select(F.col("id").alias("subject_id"), F.col("ep_status").alias("current_ep_status"), F.lit(20).alias("target_ep_status"), F.lit("a name").alias("subject_name"))
    again = shown.withColumn("target_ep_status", F.when(F.col("subject_id") % 10 == 0, 21).otherwise(20)).withColumn("subject_name", F.lit("another name"))
    return merge.preview_changes(shown, again)


@query("""SELECT c.id, c.rate, s.name AS subject_name, s.type AS subject_type, s.eps FROM user_collection c JOIN subject s ON s.id = c.subject_id""")
def nested_subjects(t: Tables) -> DataFrame:
    rows = collections.nested(collections.with_subjects(t.user_collection, t.subject))
    return rows.select("id", "rate", F.col("subject.name").alias("subject_name"), "subject.subject_type", "subject.eps")


@query("SELECT id FROM subject WHERE id % 3 = 0 AND id < 6000")
def many_ids(t: Tables) -> DataFrame:
    """A list so long that it is joined."""
    return filters.among(t.subject, "id", list(range(0, 6000, 3))).select("id")


@query("""SELECT 'subject' AS source, id FROM subject WHERE id % 7 <> 0 UNION ALL SELECT 'tag', id FROM subject_tag WHERE subject_id % 7 <> 0
    UNION ALL SELECT 'relation', subject_id FROM subject_relation WHERE subject_id % 7 <> 0 AND related_subject_id % 7 <> 0""")
def deleted_subjects(t: Tables) -> DataFrame:
    """Subjects deleted with their tags and with relations from and to them."""
    ids = t.subject.filter("id % 7 = 0").select("id").union(t.spark.range(0, 200, 7).select("id")).distinct()
    children = {"tag": (t.subject_tag, ["subject_id"]), "relation": (t.subject_relation, ["subject_id", "related_subject_id"])}
    left, rest = merge.delete_cascading(t.subject, ids, "id", children)
    out = left.select(F.lit("subject").alias("source"), "id").unionByName(rest["tag"].select(F.lit("tag").alias("source"), "id"))
    return out.unionByName(rest["relation"].select(F.lit("relation").alias("source"), F.col("subject_id").alias("id")))


@query("SELECT bangumi_id, name FROM subject UNION ALL SELECT -bangumi_id, 'new' FROM subject WHERE bangumi_id % 2 = 0 AND bangumi_id > 0")
def created_subjects(t: Tables) -> DataFrame:
    """Subjects created under ids that nobody has; those taken are refused, and an id asked for twice is created once."""
    own = t.subject.select("bangumi_id", "name")
    asked = own.filter("bangumi_id > 0").select(F.when(F.col("bangumi_id") % 2 == 0, -F.col("bangumi_id")).otherwise(F.col("bangumi_id")).alias("bangumi_id"), F.lit("new").alias("name"))
    return merge.insert_absent(own, asked.unionByName(asked.withColumn("name", F.lit("an older one"))), ["bangumi_id"], "name")[0]


@query("""SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS place FROM (
      SELECT id, updated_at FROM user_collection WHERE (updated_at, id) < (TIMESTAMP '1998-03-05 00:00:00', 500) ORDER BY updated_at DESC, id DESC LIMIT 20)""")
def collections_after(t: Tables) -> DataFrame:
    """The page after a given row, without an offset."""
    found = paging.page_after(t.user_collection.select("id", "updated_at"), [("updated_at", False), ("id", False)], (datetime(1998, 3, 5), 500))
    return paging.numbered(found)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_event_counts(t: Tables) -> DataFrame:
    """The streaming plan over the table."""
    return counters.daily_counts(t.raw("events"), "ts", ["event_type"])


@query("""SELECT event_id, event_type AS endpoint, r.key_kind, r.hits, r.seconds FROM events JOIN (VALUES ('click', 'ip', 5, 60), ('purchase', 'email', 1, 3600)) r(endpoint, key_kind, hits, seconds) ON r.endpoint = events.event_type""")
def endpoint_rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("click", "ip", 5, 60), ("purchase", "email", 1, 3600)], "endpoint string, key_kind string, hits int, seconds int")
    return keyed.with_rules(t.raw("events").select("event_id", F.col("event_type").alias("endpoint")), rules)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, event_id, n, CASE WHEN good THEN NULL ELSE ts END AS opened, CASE WHEN good THEN 0 ELSE 1 END AS hits, true AS allowed FROM e WHERE n = 1
      UNION ALL SELECT x.user_id, x.event_id, x.n, CASE WHEN x.hits >= 3 THEN x.opened WHEN x.good THEN NULL ELSE coalesce(x.opened, x.ts) END, CASE WHEN x.hits >= 3 THEN x.hits WHEN x.good THEN 0 ELSE x.hits + 1 END, x.hits < 3
      FROM (SELECT e.user_id, e.event_id, e.n, e.ts, e.good, CASE WHEN e.ts >= s.opened + INTERVAL 2 DAY THEN NULL ELSE s.opened END AS opened, CASE WHEN e.ts >= s.opened + INTERVAL 2 DAY THEN 0 ELSE s.hits END AS hits
            FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) x)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(hits AS BIGINT) AS hits, allowed FROM s""")
def failure_locks(t: Tables) -> DataFrame:
    """Locked after three failures within two days of the first; a success clears the count."""
    rows = t.raw("events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", (F.col("event_type") == "purchase").alias("success"))
    return limits.limited_table(rows, limits.Rule(3, 2 * 86_400, resets=True)).select("key", "event_id", "hits", "allowed")


# Places in an order over all rows: T3, T8, R8

LINES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in LINES)}) AS place FROM lineitem")
def numbered_lines(t: Tables) -> DataFrame:
    """Every line with its place among all, numbered range by range."""
    rows = t.raw("lineitem").select(*LINES)
    return ordered.Numbered(rows, [F.col(c) for c in LINES]).places().select("l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query(f"""SELECT l_orderkey, l_linenumber, l_extendedprice, 4980 + row_number() OVER (ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in LINES)}) AS place
    FROM (SELECT * FROM lineitem ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in LINES)} LIMIT 20 OFFSET 4980)""")
def deep_page(t: Tables) -> DataFrame:
    """The 250th page of all lines, newest first; it reads the ranges that it lies in."""
    rows = t.raw("lineitem").select(*LINES)
    return ordered.Numbered(rows, [F.col(c).desc() for c in LINES]).page(250).select("l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query("""SELECT event_id, max(epoch_us(hour) - place) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) + place AS strict
    FROM (SELECT event_id, date_trunc('hour', ts) AS hour, row_number() OVER (ORDER BY event_id) AS place FROM events)""")
def strict_stamps(t: Tables) -> DataFrame:
    """Stamps that many events share, made strictly increasing in the order of arrival."""
    rows = t.raw("events").select("event_id", F.date_trunc("hour", "ts").alias("hour"))
    return ordered.strictly_increasing(rows, "hour", ["event_id"]).select("event_id", "strict")


# Previews that expire: R5

PREVIEWS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, CASE event_type WHEN 'signup' THEN 'save' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'invalidate' ELSE 'find' END AS op FROM events),
    s AS (SELECT *, last_value(CASE WHEN op IN ('save', 'complete') THEN {'ts': ts, 'id': event_id, 'op': op} END IGNORE NULLS) OVER w AS stored, last_value(CASE WHEN op = 'invalidate' THEN {'ts': ts, 'id': event_id} END IGNORE NULLS) OVER w AS marked
          FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT *, coalesce(ts < stored.ts + INTERVAL 1 DAY, false) AS alive, coalesce(marked > {'ts': stored.ts, 'id': stored.id}, false) AS gone FROM s)
    SELECT key, event_id, op, CASE WHEN NOT alive THEN 'MISSING' WHEN gone THEN 'INVALIDATED' WHEN stored.op = 'save' THEN 'PENDING' ELSE 'COMPLETED' END AS status, CASE WHEN alive THEN concat('of ', stored.id) END AS value FROM a"""


def _preview_events(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "save").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "invalidate").otherwise("find")
    return t.raw("events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), F.concat(F.lit("of "), F.col("event_id").cast("string")).alias("value"))


@query(PREVIEWS)
def preview_lookups(t: Tables) -> DataFrame:
    """What is alive after each event of a user, whose previews live for a day."""
    return previews.previewed_table(_preview_events(t), 86_400).drop("ts")


@query(PREVIEWS)
def previews_streamed(t: Tables) -> DataFrame:
    """The same from a stream, drained, stopped, fed with the second half of the month and drained again from its state."""
    rows, path = _preview_events(t), fresh_path(t.spark, "previews")
    middle = F.lit("2024-01-16").cast("timestamp")
    for part in (rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = previews.previewed(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), 86_400)
        with previews.rocks(t.spark):
            counters.drain(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.schema(previews.SEEN).parquet(f"{path}/out").drop("ts")


# Previews executed once: W12

EXECUTIONS = """WITH c AS (SELECT user_id, id, ep_status FROM user_collection WHERE type = 3),
    u AS (SELECT user_id, bool_or(id % 4 = 1) AS changed, list_sort(list(id) FILTER (id % 10 NOT IN (3, 7))) AS succeeded, list_sort(list(id) FILTER (id % 10 = 3)) AS skipped, list_sort(list(id) FILTER (id % 10 = 7)) AS failed
          FROM c GROUP BY user_id),
    r AS (SELECT u.*, k.k, k.minute FROM u, (VALUES (0, 1), (1, 5), (2, 9), (3, 10), (4, 20)) k(k, minute)),
    s AS (SELECT user_id, k, changed, succeeded, skipped, failed,
            CASE WHEN user_id % 7 = 0 THEN 'NOT_FOUND' WHEN user_id % 5 = 0 THEN CASE WHEN minute < 10 THEN 'CONFLICT' ELSE 'NOT_FOUND' END
                 WHEN changed THEN CASE WHEN k = 0 THEN 'PREVIEW_CHANGED' WHEN minute < 10 THEN 'CONFLICT' ELSE 'NOT_FOUND' END
                 WHEN minute < 11 THEN 'COMPLETED' ELSE 'NOT_FOUND' END AS state FROM r)
    SELECT user_id * 10 + k AS request_id, state, state = 'COMPLETED' AND k > 0 AS replayed,
      CASE WHEN state = 'COMPLETED' THEN concat(coalesce(array_to_string(succeeded, ','), ''), '/', coalesce(array_to_string(skipped, ','), ''), '/', coalesce(array_to_string(failed, ','), '')) END AS lists FROM s
    UNION ALL SELECT user_id * 10 + 9, 'NOT_FOUND', false, NULL FROM u"""


def _executed(t: Tables) -> tuple[ledger.Executed, ledger.Executed]:
    """Each user's preview of all that they watch, asked for at minutes 1, 5 and 20, and in a second call at 9 and 10; minute 10 is its end.

    Meanwhile some rows have moved on (id % 10 = 3) or gone (7), and users with an id % 4 = 1 have another recomputation.
    """
    own = written(t.user_collection.filter("type = 3").select("user_id", F.col("id").alias("subject_id"), "ep_status"), "watching")
    minute = lambda n: F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    name = F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("preview_id")
    items = own.select("user_id", name, "subject_id", F.col("ep_status").alias("current_ep_status"), (F.col("ep_status") + 1).alias("target_ep_status"))
    again = items.withColumn("target_ep_status", F.col("target_ep_status") + F.when(F.col("subject_id") % 4 == 1, 1).otherwise(0))
    users = own.select("user_id").distinct()
    shown = users.select("user_id", name, F.when(F.col("user_id") % 5 == 0, "INVALIDATED").otherwise("PENDING").alias("status"), F.when(F.col("user_id") % 7 == 0, minute(0)).otherwise(minute(10)).alias("expires_at"))
    base = own.filter("subject_id % 10 <> 7").withColumn("ep_status", F.col("ep_status") + F.when(F.col("subject_id") % 10 == 3, 5).otherwise(0))

    def asked(minutes: list[tuple[int, int]]) -> DataFrame:
        each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("minute")) for k, m in minutes]))
        return users.select("user_id", name, each).select((F.col("user_id") * 10 + F.col("k")).alias("request_id"), "user_id", "preview_id", minute(F.col("minute")).alias("at"))

    unknown = asked([(9, 2)]).withColumn("preview_id", F.lit("unknown"))
    none = t.spark.createDataFrame([], ledger.LEDGER)
    one = ledger.execute(asked([(0, 1), (1, 5), (4, 20)]).unionByName(unknown), shown, items, again, base, none)
    two = ledger.execute(asked([(2, 9), (3, 10)]), one.previews, one.items, again, one.base, one.ledger)
    return one, two


@query(EXECUTIONS)
def preview_executions(t: Tables) -> DataFrame:
    """Answers to first, repeated, late and unknown requests for previews, some expired, invalid or changed."""
    both = [x.answers for x in _executed(t)]
    lists = F.concat_ws("/", *[F.array_join(x, ",") for x in ledger.LISTS])
    return both[0].unionByName(both[1]).select("request_id", "state", "replayed", F.when(F.col("succeeded").isNotNull(), lists).alias("lists"))


@query("""SELECT user_id, id AS subject_id, ep_status + CASE WHEN id % 10 = 3 THEN 5 WHEN user_id % 7 = 0 OR user_id % 5 = 0 OR changed THEN 0 ELSE 1 END AS ep_status
    FROM (SELECT *, bool_or(id % 4 = 1) OVER (PARTITION BY user_id) AS changed FROM user_collection WHERE type = 3) WHERE id % 10 <> 7""")
def executed_progress(t: Tables) -> DataFrame:
    """Progress after both calls: what has been replayed is written once."""
    return _executed(t)[1].base.select("user_id", "subject_id", "ep_status")


# Names that differ in case only: F6, F14, A14, D2, X6 as the catalog's database compares them

SPELT = "CASE id % 3 WHEN 0 THEN upper({0}) WHEN 1 THEN lower({0}) ELSE {0} END"


def _spelt(t: Tables, name: str, column: str) -> DataFrame:
    """A view in which a column's case changes from row to row."""
    return ignoring_case(getattr(t, name).withColumn(column, F.expr(SPELT.format(column))), column)


@query("SELECT lower(nickname) AS name, count(*) AS count, count(DISTINCT id) AS n FROM account GROUP BY 1")
def tag_counts_any_case(t: Tables) -> DataFrame:
    """Groups of names without regard to case."""
    own = _spelt(t, "account", "nickname")
    counts = catalog.tags(own.select("id", F.col("nickname").alias("name"))).drop("id")
    ids = own.groupBy(F.col("nickname").alias("name")).agg(F.count_distinct("id").alias("n"))
    return binary(counts.join(ids, "name")).select(F.lower("name").alias("name"), "count", "n")


@query(f"""SELECT id, {SPELT.format('username')} AS username FROM account WHERE lower(username) = 'customer#000000009' OR lower(username) LIKE '%00001_'""")
def account_any_case(t: Tables) -> DataFrame:
    """Equality and a pattern, neither in the case of the names."""
    own = _spelt(t, "account", "username")
    return binary(own.filter((F.col("username") == "CUSTOMER#000000009") | F.col("username").like("%00001_")).select("id", "username"))


@query("SELECT count(DISTINCT lower(nickname)) AS n_names FROM account")
def distinct_any_case(t: Tables) -> DataFrame:
    return _spelt(t, "account", "nickname").select("nickname").distinct().agg(F.count("*").alias("n_names"))


@query("SELECT a.id, count(*) AS n FROM account a JOIN account b ON a.nickname = b.nickname AND b.id % 50 = 0 GROUP BY a.id")
def joined_any_case(t: Tables) -> DataFrame:
    """A join of names spelt differently on its sides; the other side is counted first."""
    own = _spelt(t, "account", "nickname").select("id", "nickname")
    other = ignoring_case(t.account.filter("id % 50 = 0").select(F.initcap("nickname").alias("nickname"))).groupBy("nickname").agg(F.count("*").alias("n"))
    return own.join(other, "nickname").select("id", "n")


@query("SELECT id, name, 'ring' AS keyword FROM subject WHERE lower(name) LIKE '%ring%' UNION ALL SELECT id, name, 'BOLT' FROM subject WHERE lower(name) LIKE '%bolt%' UNION ALL SELECT id, name, 'o' FROM subject WHERE lower(name) LIKE '%o%'")
def search_indexed(t: Tables) -> DataFrame:
    """Keywords by an index over all names; the last is too short for it."""
    index = keywords.KeywordIndex(t.subject.select("id", "name"), "id", "name")
    found = [index.search(k).withColumn("keyword", F.lit(k)) for k in ("ring", "BOLT", "o")]
    return found[0].unionByName(found[1]).unionByName(found[2])
