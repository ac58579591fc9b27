"""Queries of the ingestion: feeds land as JSON made from the driver's tables, are read under their schemas, cleaned and merged."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import values
from .operators import lookups, merge
from .plans import activity, ingestion
from .registry import Tables, query
from .sources import readers
from .sources.scratch import fresh_path
from .streaming import audit

#: A date as feeds write it: whole, unpadded, with signs for year, month and day, with slashes and blanks, not at all, or empty.
DAY = "(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT))"
WRITTEN = f"""CASE p_partkey % 6 WHEN 0 THEN CAST({DAY} AS VARCHAR(10)) WHEN 1 THEN concat(year({DAY}), '-', month({DAY}), '-', day({DAY})) WHEN 2 THEN concat(year({DAY}), '年', month({DAY}), '月', day({DAY}), '日')
    WHEN 3 THEN concat(year({DAY}), '/ ', month({DAY}), ' /', day({DAY})) WHEN 4 THEN 'soon 2' ELSE '' END"""
IS_DAY = f"CASE WHEN p_partkey % 6 < 4 THEN {DAY} END"


def _land(t: Tables, name: str, df: DataFrame, by: tuple[str, ...] = ()) -> str:
    path = fresh_path(t.spark, f"feed-{name}")
    (df.write.partitionBy(*by) if by else df.write).json(path)
    return path


def _part(t: Tables, columns: str) -> DataFrame:
    return t.spark.sql(f"SELECT {columns} FROM {{part}}", part=t.raw("part"))


def _subject_feed(t: Tables) -> DataFrame:
    rows = _part(t, f"""CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS name, p_brand AS name_cn, CASE WHEN p_partkey % 4 <> 0 THEN 3 END AS type,
        CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) ELSE 0 END AS eps, CASE WHEN p_partkey % 5 = 0 THEN 30 END AS total_episodes, {WRITTEN} AS date, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size = 50 END AS nsfw,
        named_struct('large', p_type) AS images, CASE WHEN p_partkey % 7 <> 0 THEN named_struct('score', (p_partkey % 101) / 10.0, 'rank', CAST(p_partkey % 1000 AS INT)) END AS rating,
        named_struct('collect', CAST(p_partkey % 5000 AS INT)) AS collection,
        array(named_struct('name', 'A', 'count', p_partkey % 7), named_struct('name', 'B', 'count', p_partkey % 5), named_struct('name', 'A', 'count', p_partkey % 3), named_struct('name', NULL, 'count', 1)) AS tags""")  # fmt: skip
    return readers.landed(t.spark, _land(t, "subject", rows), "subject")


@query(f"""SELECT CAST(p_partkey AS INT) AS bangumi_id, CASE WHEN p_partkey % 13 <> 0 THEN p_name ELSE '' END AS name, p_brand AS name_cn, CASE WHEN p_partkey % 4 <> 0 THEN 3 ELSE 2 END AS type,
    nullif(greatest(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) ELSE 0 END, CASE WHEN p_partkey % 5 = 0 THEN 30 ELSE 0 END), 0) AS eps, {IS_DAY} AS air_date, CAST(dayofweek({IS_DAY}) AS INT) AS air_weekday,
    p_type AS image, CASE WHEN p_partkey % 7 <> 0 THEN CAST((p_partkey % 101) / 10.0 AS DOUBLE) END AS score, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 1000 AS INT) END AS rank,
    CAST(p_partkey % 5000 AS INT) AS collection_total FROM part WHERE (p_partkey % 3 = 0 OR p_size <> 50) AND {WRITTEN} >= '1996'""")
def feed_subjects(t: Tables) -> DataFrame:
    return ingestion.clean_subjects(_subject_feed(t), since="1996").drop("summary", "volumes", "nsfw").withColumn("score", F.col("score").cast("double"))


@query("SELECT CAST(p_partkey AS INT) AS bangumi_id, 'A' AS name, CAST(p_partkey % 3 AS INT) AS count FROM part UNION ALL SELECT CAST(p_partkey AS INT), 'B', CAST(p_partkey % 5 AS INT) FROM part")
def feed_tags(t: Tables) -> DataFrame:
    return ingestion.clean_tags(_subject_feed(t))


@query(f"SELECT CAST(p_partkey AS INT) AS bangumi_id, {WRITTEN} AS date, CAST(1990 + p_partkey % 3 AS INT) AS year, CAST(1 + p_partkey % 2 AS INT) AS month FROM part")
def feed_browse(t: Tables) -> DataFrame:
    rows = _part(t, f"CAST(p_partkey AS INT) AS id, {WRITTEN} AS date, 1990 + p_partkey % 3 AS year, 1 + p_partkey % 2 AS month, CAST(p_partkey / 150 AS INT) AS page")
    pages = rows.groupBy("year", "month", "page").agg(F.collect_list(F.struct("id", "date")).alias("data"), F.count("*").alias("total")).drop("page")
    return readers.landed_browse(t.spark, _land(t, "browse", pages, ("year", "month")))


@query("SELECT CAST(p_partkey AS INT) AS bangumi_id, p_name AS name, p_brand AS name_cn, CAST(count(*) OVER (PARTITION BY p_partkey // 50) AS INT) AS total FROM part")
def feed_search(t: Tables) -> DataFrame:
    rows = _part(t, "p_partkey DIV 50 AS page, CAST(p_partkey AS INT) AS id, p_name AS name, p_brand AS name_cn")
    pages = rows.groupBy("page").agg(F.collect_list(F.struct("id", "name", "name_cn")).alias("data"), F.count("*").alias("total")).drop("page")
    return readers.landed_search(t.spark, _land(t, "search", pages)).drop("date")


@query(f"""SELECT p_partkey * 2 AS subject_id, CAST(p_partkey AS INT) AS bangumi_ep_id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS type, CAST(p_size / 2.0 AS DOUBLE) AS sort, p_name AS name, {IS_DAY} AS airdate, p_brand AS description,
    CASE WHEN {IS_DAY} < DATE '1998-01-01' THEN 'Air' WHEN {IS_DAY} = DATE '1998-01-01' THEN 'Today' ELSE 'NA' END AS status FROM part""")
def feed_episodes(t: Tables) -> DataFrame:
    rows = _part(t, f"CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 3 <> 0 THEN 1 END AS type, p_size / 2.0 AS sort, p_name AS name, {WRITTEN} AS airdate, p_brand AS `desc`")
    landed = readers.landed(t.spark, _land(t, "episode", rows), "episode")
    return ingestion.clean_episodes(landed, (F.col("id") * 2).cast("long"), date(1998, 1, 1)).drop("name_cn", "duration").withColumn("sort", F.col("sort").cast("double"))


@query("""SELECT CAST(p_partkey // 500 AS INT) AS station, CAST(dense_rank() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey % 7) - 1 AS INT) AS day,
    CAST(row_number() OVER (PARTITION BY p_partkey // 500, p_partkey % 7 ORDER BY p_partkey) - 1 AS INT) AS place, CAST(p_partkey AS INT) AS bangumi_id FROM part""")
def feed_calendar(t: Tables) -> DataFrame:
    """A calendar of at most 500 items for each station, so that files grow in number, not in size."""
    days = _part(t, "p_partkey DIV 500 AS station, p_partkey % 7 AS day, CAST(p_partkey AS INT) AS id").groupBy("station", "day").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("items"))
    weeks = days.groupBy("station").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "items"))), lambda d: F.struct(d["items"].alias("items"))).alias("week"))
    path = fresh_path(t.spark, "feed-calendar")
    weeks.select("station", F.to_json("week")).write.partitionBy("station").text(path)
    return readers.landed_calendar(t.spark, path)


REPLACED = """SELECT subject_id, related_subject_id, relation FROM subject_relation WHERE subject_id % 3 <> 0
    UNION ALL SELECT related_subject_id, subject_id, CASE relation WHEN 'prequel' THEN 'sequel' WHEN 'spin_off' THEN 'parent_story' WHEN 'side_story' THEN 'parent_story' ELSE relation END FROM subject_relation WHERE subject_id % 3 <> 0
    UNION ALL SELECT subject_id, related_subject_id, 'prequel' FROM subject_relation WHERE subject_id % 6 = 0 AND subject_id % 5 <> 1
    UNION ALL SELECT related_subject_id, subject_id, 'sequel' FROM subject_relation WHERE subject_id % 6 = 0 AND subject_id % 5 <> 1"""


def relation_feed(t: Tables) -> DataFrame:
    """Feed rows about every third subject: every fifth of another type, odd ones about subjects that aren't there."""
    rows = t.spark.sql("""SELECT CAST(n_nationkey AS BIGINT) AS subject_id, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 107 ELSE 100000000 + n_nationkey END AS id, CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 2 END AS type,
        'prequel' AS relation FROM {nation} WHERE n_nationkey % 3 = 0""", nation=t.raw("nation"))  # fmt: skip
    return t.spark.read.schema("subject_id bigint, id int, type int, relation string").json(_land(t, "relation", rows))


def _relations(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = lookups.both_ways(t.subject_relation, "subject_id", "related_subject_id", "relation", values.inverse_relation)
    return ingestion.merged_relations(base, relation_feed(t), t.subject.select("id", (F.col("bangumi_id") + 7).cast("int").alias("bangumi_id")))


@query(REPLACED)
def replaced_relations(t: Tables) -> DataFrame:
    return _relations(t)[0]


@query("SELECT subject_id, CAST(100000000 + subject_id AS INT) AS bangumi_id FROM subject_relation WHERE subject_id % 6 = 3 AND subject_id % 5 <> 1")
def missing_relations(t: Tables) -> DataFrame:
    return _relations(t)[1].select("subject_id", "bangumi_id")


@query("SELECT CAST(id AS INT) AS bangumi_id FROM subject WHERE import_status <> 1")
def resumed_ids(t: Tables) -> DataFrame:
    return ingestion.unseen(t.subject.select("bangumi_id"), t.subject)


@query("SELECT count(*) FILTER (event_type <> 'error') AS imported, count(*) FILTER (event_type = 'error') AS failed, count(*) AS scanned FROM events")
def import_counts(t: Tables) -> DataFrame:
    return ingestion.success_counts(t.raw("events").select((F.col("event_type") != "error").alias("ok")))


@query("""SELECT CASE WHEN bangumi_id % 2 = 0 THEN id END AS id, bangumi_id, CASE WHEN fresh THEN concat(name, '!') ELSE name END AS name, CASE WHEN NOT fresh THEN score END AS score,
      CASE WHEN bangumi_id % 2 = 0 THEN air_date ELSE DATE '2024-01-20' END AS created_at FROM (SELECT *, bangumi_id % 2 <> 0 OR bangumi_id % 3 = 0 AS fresh FROM subject)""")
def upserted_subjects(t: Tables) -> DataFrame:
    """The base holds the even subjects, the feed all odd ones and every third: known ones keep their id and, where they have one, the day they were created; fresh nulls hold; of a subject that comes twice the larger row counts."""
    own = t.subject.select("id", "bangumi_id", "name", "score", F.coalesce("air_date", F.lit(date(2024, 1, 20))).alias("created_at"))
    fed = own.filter("bangumi_id % 2 <> 0 OR bangumi_id % 3 = 0")
    fresh = fed.select("bangumi_id", F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("double").alias("score"), F.lit(date(2024, 1, 20)).alias("created_at"))
    merged = ingestion.merged_subjects(own.filter("bangumi_id % 2 = 0"), fresh.unionByName(fresh.withColumn("name", F.lit("!"))))
    undated = t.subject.filter("air_date IS NULL AND bangumi_id % 2 = 0").select("bangumi_id", F.lit(True).alias("undated"))
    return merged.join(undated, "bangumi_id", "left").withColumn("created_at", F.when(F.col("undated").isNull(), F.col("created_at"))).drop("undated")


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS id, p_partkey % 50 AS subject_id, p_partkey AS bangumi_ep_id, CASE WHEN p_partkey % 2 = 1 OR p_partkey % 3 = 0 THEN 'fresh' ELSE p_name END AS name FROM part""")
def upserted_episodes(t: Tables) -> DataFrame:
    own = _part(t, "p_partkey AS id, p_partkey % 50 AS subject_id, p_partkey AS bangumi_ep_id, p_name AS name")
    fresh = own.filter("id % 2 = 1 OR id % 3 = 0").select("subject_id", "bangumi_ep_id", F.lit("fresh").alias("name"))
    return ingestion.merged_episodes(own.filter("id % 2 = 0"), fresh)


@query("""SELECT g.id, g.subject_id, g.name, CASE WHEN g.subject_id % 2 = 0 AND g.name = 'A' THEN g.count + 5 ELSE g.count END AS count FROM subject_tag g
    UNION ALL SELECT CAST(NULL AS BIGINT), s.subject_id, 'new', 1 FROM (SELECT DISTINCT subject_id FROM subject_tag) s""")
def upserted_tags(t: Tables) -> DataFrame:
    """Counts of fresh tags hold, the last of a tag named twice; tags that the feed lacks stay."""
    own = t.subject_tag
    more = own.filter("subject_id % 2 = 0 AND name = 'A'").select("subject_id", "name", (F.col("count") + 5).alias("count"))
    new = own.select("subject_id", F.lit("new").alias("name"), F.lit(1).alias("count")).distinct()
    return ingestion.merged_tags(own, more.unionByName(more.withColumn("count", F.col("count") - 1)).unionByName(new))


@query("""SELECT id, mode, status, subject_count, error_message, CAST(started_at AS DATE) AS started, CAST(completed_at AS DATE) AS completed FROM (
      SELECT id, mode, CASE WHEN id % 2 = 0 THEN 'COMPLETED' WHEN id % 5 = 1 THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE WHEN id % 2 = 0 OR id % 5 = 1 THEN 7 ELSE 0 END AS subject_count,
        CASE WHEN id % 5 = 1 AND id % 2 = 1 THEN 'broke' END AS error_message, DATE '2024-02-01' AS started_at, CASE WHEN id % 2 = 0 OR id % 5 = 1 THEN DATE '2024-02-02' END AS completed_at FROM import_record)""")
def job_records(t: Tables) -> DataFrame:
    """All import runs opened anew; the even ones completed, of the odd ones some failed."""
    none = t.spark.createDataFrame([], "id long, mode string, season_key string, started_at timestamp_ntz, completed_at timestamp_ntz, status string, subject_count int, error_message string, created_at timestamp_ntz")
    starts = t.import_record.select("id", "mode", F.lit(None).cast("string").alias("season_key"))
    running = merge.opened(none, starts, F.lit("2024-02-01").cast("timestamp_ntz")).fillna(0, subset=["subject_count"])
    failed = (F.col("id") % 2 == 1) & (F.col("id") % 5 == 1)
    ends = starts.filter("id % 2 = 0 OR id % 5 = 1").select((F.col("id")).alias("id"), F.when(failed, "FAILED").alias("status"), F.lit(7).alias("subject_count"), F.when(failed, "broke").alias("error_message"))
    done = merge.closed(running, ends.unionByName(ends.limit(1).withColumn("id", F.lit(-1).cast("long"))), F.lit("2024-02-02").cast("timestamp_ntz"))
    return done.select("id", "mode", "status", "subject_count", "error_message", F.to_date("started_at").alias("started"), F.to_date("completed_at").alias("completed"))


AUDIT = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ann' WHEN event_id % 3 = 1 THEN 'b@x.org' END AS username,
    CASE event_id % 3 WHEN 0 THEN '[{"username":"ann","password":"***"}]' WHEN 1 THEN '[{"k":1},{"username":" ","email":"b@x.org","code":"***"}]' ELSE '[]' END AS params,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status, CASE WHEN event_type = 'error' THEN 'failed' END AS error_msg, CAST(event_id % 1000 AS BIGINT) AS duration_ms FROM events"""


@query(AUDIT)
def audit_rows(t: Tables) -> DataFrame:
    return activity.audit_rows(_calls(t)).select(F.col("path").cast("long").alias("event_id"), "username", "params", "status", "error_msg", "duration_ms")


@query(AUDIT)
def audit_streamed(t: Tables) -> DataFrame:
    """The same through a stream that ends and goes on, each batch written once."""
    calls, path = _calls(t), fresh_path(t.spark, "audit")
    odd = F.col("path").cast("long") % 2 == 1
    for part in (calls.filter(odd), calls.filter(~odd)):
        part.write.mode("append").parquet(f"{path}/in")
        audit.drain_once(t.spark.readStream.schema(calls.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select(F.col("path").cast("long").alias("event_id"), "username", "params", "status", "error_msg", "duration_ms")


def _calls(t: Tables) -> DataFrame:
    args = F.when(F.col("event_id") % 3 == 0, F.array(F.lit('{"username":"ann","password":"s\\"1"}'))).when(F.col("event_id") % 3 == 1, F.array(F.lit('{"k":1}'), F.lit('{"username":" ","email":"b@x.org","code":"12"}'))).otherwise(F.array().cast("array<string>"))
    return t.raw("events").select(
        args.alias("args"), F.lit("LOGIN").alias("action"), F.lit("CLIENT").alias("module"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("started_at"),
        F.timestamp_add("MILLISECOND", (F.col("event_id") % 1000).cast("int"), F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("ended_at"), "user_id", F.lit("POST").alias("method"),
        F.col("event_id").cast("string").alias("path"), F.lit(None).cast("string").alias("ip"), F.lit(None).cast("string").alias("user_agent"),
    )


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT -o_orderkey, CAST(o_orderdate AS DATE) FROM orders")
def appended(t: Tables) -> DataFrame:
    """Rows added twice to one folder, by a partition column."""
    path = fresh_path(t.spark, "appended")
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 4).alias("part"))
    readers.append(rows, path, "part")
    readers.append(rows.withColumn("id", -F.col("id")), path, "part")
    return t.spark.read.parquet(path).select("id", "day")


@query("""SELECT conv_id, turn, role, text AS content, CAST(NULL AS VARCHAR) AS tool_calls, true AS null_kept, CAST(NULL AS VARCHAR) AS nonsense FROM conversations""")
def messages_json(t: Tables) -> DataFrame:
    """Messages as JSON and back; text that is no message gives null."""
    message = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.lit("2024-01-20T00:00:00").alias("created_at"))
    rows = t.raw("conversations").select("conv_id", "turn", values.encoded(message).alias("json"))
    back = rows.select("conv_id", "turn", values.decoded(F.col("json")).alias("m"), F.contains("json", F.lit('"tool_calls":null')).alias("null_kept"), values.decoded(F.concat(F.lit("x"), "json")).alias("bad"))
    return back.select("conv_id", "turn", "m.role", "m.content", "m.tool_calls", "null_kept", F.col("bad.role").alias("nonsense"))


@query("""SELECT event_id, event_id % 4 < 2 AS safe, CASE event_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'webp' END AS extension,
    CASE event_id % 4 WHEN 0 THEN 'CLIENT_DISCONNECTED' WHEN 1 THEN 'MODEL_RESPONSE_INVALID' WHEN 2 THEN 'INTERNAL_ERROR' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'request_id=r' ELSE 'request_id=r,tool=t' END AS kept,
    concat('x,', event_type, ',y') AS merged FROM events""")
def small_functions(t: Tables) -> DataFrame:
    """Ids, extensions of images, kinds of errors, kept fields, and two lists merged."""
    pick = lambda n, *cases: F.get(F.array(*[F.lit(c) for c in cases]), (F.col("event_id") % n).cast("int"))
    ids = pick(4, "req-1.2_x", " trimmed ", "bad id!", "")
    urls = pick(5, "https://h/a/b.JPG?x=1.png", "http://h/c.webp", "http://h/d.gif", "no url", "http://h/jpg")
    fields = F.create_map(F.lit("request_id"), F.lit("r"), F.lit("tool"), F.when(F.col("event_id") % 2 == 1, "t"), F.lit("secret"), F.lit("s"))
    kept = values.kept_fields(fields, ["request_id", "tool"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.raw("events").select(
        "event_id", values.is_safe_id(ids).alias("safe"), values.url_extension(urls).alias("extension"), values.error_kind(pick(4, "CancelledError", "ValueError", "OSError", None)).alias("kind"), shown.alias("kept"),
        F.array_join(values.merged_unique(F.array(F.lit("x"), "event_type"), F.array("event_type", F.lit("y"), F.lit("x"))), ",").alias("merged"),
    )
