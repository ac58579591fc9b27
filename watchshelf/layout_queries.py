"""Queries over tables laid out by key: lookups and joins without moving rows, merges that write changed buckets only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed_queries import REPLACED, relation_feed
from .functions import values
from .operators import lookups
from .operators.keyed_table import KeyedTable
from .operators.patched import PatchedTable, patch_relations
from .plans import ingestion
from .registry import Tables, query

# Lookups and joins: S2, S3, J1, J2


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, i.position FROM lineitem JOIN (VALUES (0, 39), (1, 7), (2, 3), (3, 101)) i(position, id) ON i.id = l_orderkey""")
def keyed_lookup(t: Tables) -> DataFrame:
    """The lines of some orders from a table in buckets by order; an order asked for twice comes once, one that isn't there not at all."""
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return KeyedTable(lines, "l_orderkey").lookup([39, 7, 39, 3, 101, 10**9], numbered=True)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus, o_totalprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 11 <> 0")
def keyed_join(t: Tables) -> DataFrame:
    """Every line with its order, bucket by bucket."""
    lines = KeyedTable(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    orders = KeyedTable(t.raw("orders").filter("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return lines.joined(orders, "left")


@query("""SELECT c.id, c.subject_id, s.name, s.score FROM user_collection c JOIN subject s ON s.id = c.subject_id""")
def keyed_collections(t: Tables) -> DataFrame:
    """All collections with their subjects, of which few are collected at all."""
    own = KeyedTable(t.user_collection.select("id", "subject_id"), "subject_id")
    return own.joined(KeyedTable(t.subject.select(F.col("id").alias("key"), "name", "score"), "key"))


@query("SELECT event_id, e.event_type, n FROM events e LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) k ON k.event_type = e.event_type")
def keyed_join_hot(t: Tables) -> DataFrame:
    """Each event with the size of its kind; a kind with more rows than a bucket should have is kept out of the buckets."""
    events = t.raw("events")
    kinds = events.filter("event_type <> 'error'").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return KeyedTable(events.select("event_id", "event_type"), "event_type").joined(KeyedTable(kinds, "kind"), "left")


# Merges in place: W1 to W4


@query("""SELECT id, CASE WHEN id % 10 = 0 THEN 'X' ELSE status END AS status, CASE WHEN id % 10 <> 0 THEN total END AS total, created_at FROM (
      SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders WHERE o_orderkey % 7 <> 0)
    UNION ALL SELECT -1 - o_orderkey, 'X', NULL, TIMESTAMP '2024-01-20 00:00:00' FROM orders WHERE o_orderkey % 10 = 0""")
def patched_orders(t: Tables) -> DataFrame:
    """Orders changed, added and deleted in place: every tenth is changed but for the time it was created, and comes once more under a new id; every fifth comes as it was."""
    own = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    table = PatchedTable(own, ["id"])
    changed = own.filter("id % 10 = 0").select("id", F.lit("X").alias("status"), F.lit(None).cast("double").alias("total"), F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz").alias("created_at"))
    table.upsert(changed.unionByName(changed.withColumn("id", -1 - F.col("id"))).unionByName(own.filter("id % 10 = 5")), keep=("created_at",), unique=True)
    table.delete(own.filter("id % 7 = 0").select("id").unionByName(own.select((F.col("id") + 10**9).alias("id"))))
    return table.rows


@query(REPLACED)
def patched_relations(t: Tables) -> DataFrame:
    """Relations replaced in the buckets of both their ends."""
    base = lookups.both_ways(t.subject_relation, "subject_id", "related_subject_id", "relation", values.inverse_relation)
    table = PatchedTable(base, ["subject_id", "related_subject_id"], by=["subject_id"])
    feed = relation_feed(t)
    wanted = feed.filter(F.col("type") == ingestion.ANIME).select("subject_id", F.col("id").alias("bangumi_id"), "relation")
    known = lookups.resolved(wanted, t.subject.select(F.col("id").alias("related_subject_id"), (F.col("bangumi_id") + 7).cast("int").alias("bangumi_id")), "bangumi_id", "related_subject_id")[0]
    patch_relations(table, known.select("subject_id", "related_subject_id", "relation"), feed.select(F.col("subject_id").alias("id")).distinct(), values.inverse_relation)
    return table.rows
