"""Tables in buckets by key: lookups, joins without an exchange, merges that leave other files as they are."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from watchshelf.functions import values
from watchshelf.operators import lookups, merge
from watchshelf.operators.keyed_table import KeyedTable
from watchshelf.operators.patched import BUCKET, PatchedTable, patch_relations


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_move_no_rows(spark, no_broadcast):
    facts, names = spark.range(5000).select((F.col("id") % 700).alias("k"), "id"), spark.range(600).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    joined = KeyedTable(facts, "k", 8).joined(KeyedTable(names, "key", 8), "left")
    assert rows(joined) == rows(facts.join(names, facts.k == names.key, "left").drop("key"))
    assert not re.search(r"(?<!Broadcast)Exchange", plan_of(joined))
    assert "Exchange hashpartitioning" in plan_of(facts.join(names, facts.k == names.key))


def test_hot_keys_and_nulls_stay_out_of_the_buckets(spark, no_broadcast):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).cast("long").alias("k"), "id")
    table, names = KeyedTable(facts, "k", 8), KeyedTable(spark.range(90).select(F.col("id").alias("key"), F.lit("x").alias("v")), "key", 8)
    assert table.hot == [7] and table.bucketed.filter("k = 7 OR k IS NULL").count() == 0 and names.unique and not table.unique
    assert table.apart.rdd.getNumPartitions() > 0 and rows(table.rows) == rows(facts)
    for how in ("inner", "left"):
        assert rows(table.joined(names, how)) == rows(facts.join(names.rows, facts.k == F.col("key"), how).drop("key"))
    assert rows(table.lookup([7, 3])) == rows(facts.filter("k IN (3, 7)"))


def test_lookups_read_their_buckets(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    table = KeyedTable(df, "k", 16)
    found = table.lookup([5, 1999, 5, 10**7, 0], numbered=True)
    assert [(r.k, r.v, r.position) for r in found.collect()] == [(5, 15, 0), (1999, 5997, 1), (0, 0, 3)]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # plans tell of pruned buckets only where they keep the others apart
    try:
        plan = plan_of(table.lookup([5, 1999, 5, 10**7, 0]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: [1-4] out of 16", plan) and re.search(r"PushedFilters: \[.*In\(k", plan)
    assert table.lookup([]).count() == 0 and table.lookup(list(range(0, 4000, 2))).count() == 1000


def test_bloom_filters_are_written(spark):
    import pyarrow.parquet as pq

    path = KeyedTable(spark.range(1000), "id", 2).bucketed.inputFiles()
    assert len(path) == 2  # one file for each bucket
    for p in path:
        name = p.removeprefix("file://")
        assert pq.read_metadata(name).num_rows > 300 and b"PAR1" == Path(name).read_bytes()[:4]
    plain = spark.range(1000)
    plain.coalesce(1).write.parquet(f"{Path(name).parent}-plain")
    size = sum(f.stat().st_size for f in Path(f"{Path(name).parent}-plain").glob("*.parquet"))
    assert sum(Path(p.removeprefix("file://")).stat().st_size for p in path) > size + 500  # a bloom filter in each


def test_what_joins_refuse(spark):
    one, many, empty = KeyedTable(spark.range(9), "id", 4), KeyedTable(spark.range(9).select((F.col("id") % 2).alias("k")), "k", 4), KeyedTable(spark.range(0).select(F.col("id").alias("e")), "e", 4)
    with pytest.raises(ValueError, match="unique"):
        one.joined(many)
    with pytest.raises(ValueError, match="number of buckets"):
        many.joined(KeyedTable(spark.range(9), "id", 5))
    with pytest.raises(ValueError, match="one type"):
        many.joined(KeyedTable(spark.range(9).select(F.col("id").cast("int").alias("i")), "i", 4))
    with pytest.raises(ValueError, match="both tables have k"):
        many.joined(KeyedTable(spark.range(9).select("id", F.lit(1).alias("k")), "id", 4))
    assert many.joined(empty).count() == 0 and many.joined(empty, "left").count() == 9 and empty.joined(one).count() == 0


def files_of(table):
    found = {}
    for p in Path(table.path.removeprefix("file://")).glob(f"{BUCKET}=*/*.parquet"):
        found.setdefault(int(p.parent.name.split("=")[1]), set()).add((p.name, p.stat().st_mtime_ns))
    return found


def buckets_of(table, df):
    return set(table._numbers(table._placed(df)))


def test_other_files_stay(spark):
    base = spark.range(500).select("id", (F.col("id") % 9).cast("int").alias("x"), F.lit("old").alias("made"))
    table = PatchedTable(base, ["id"], 16)
    before = files_of(table)
    assert len(before) == 16
    changes = spark.createDataFrame([(3, 8, "new"), (400, 4, "old"), (9000, 1, "new")], "id int, x int, made string")  # the key is of another type, 400 is as it was
    assert base.filter("id = 400 AND x = 4").count() == 1
    touched = table.upsert(changes, keep=("made",))
    expected = buckets_of(table, changes.filter("id <> 400"))
    after = files_of(table)
    assert set(touched) == expected and {b for b in after if after[b] != before[b]} == expected
    assert rows(table.rows) == rows(merge.upsert(base, changes, ["id"], keep=("made",)))
    assert table.upsert(changes, keep=("made",)) == [] and files_of(table) == after


def test_deletes_that_empty_a_bucket(spark):
    base = spark.range(40).withColumn("x", F.lit(1))
    table = PatchedTable(base, ["id"], 8)
    one = table._stored([3]).select("id")
    ids = [r.id for r in one.collect()]
    assert ids
    gone = spark.createDataFrame([(i,) for i in [*ids, 10**6]], "id long")
    before = files_of(table)
    assert table.delete(gone) == [3]
    after = files_of(table)
    assert 3 not in after and {b: f for b, f in before.items() if b != 3} == after
    assert rows(table.rows) == rows(base.join(gone, "id", "left_anti")) and table.delete(gone) == []
    assert table.upsert(gone.withColumn("x", F.lit(2))) and table.rows.count() == 41


@pytest.mark.parametrize("partial", [False, True])
def test_merges_as_whole_snapshots_do(spark, partial):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1, 2])
    make = lambda n: spark.createDataFrame([(rng.randrange(60), rng.choice("ab"), value(), value()) for _ in range(n)], "k long, j string, x int, y int")
    base = merge.one_each(make(80), ["k", "j"])
    table = PatchedTable(base, ["k", "j"], 5, by=["k"])
    for _ in range(3):
        changes, now = make(12), rows(table.rows)
        snapshot = spark.createDataFrame(now, base.schema)
        table.upsert(changes, keep=("y",), partial=partial)
        assert rows(table.rows) == rows(merge.upsert(snapshot, changes, ["k", "j"], keep=("y",), partial=partial))


def test_a_hot_bucket_and_an_empty_table(spark):
    base = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("s"), F.col("id").alias("r"))
    table = PatchedTable(base, ["s", "r"], 4, by=["s"])
    assert rows(table.rows) == rows(base)
    assert table.delete(base.filter("s = 0 AND r > 0")) == sorted(buckets_of(table, base.filter("s = 0"))) and table.rows.filter("s = 0").count() == 1
    empty = PatchedTable(base.limit(0), ["s", "r"], 4)
    assert empty.rows.count() == 0 and empty.delete(base) == [] and empty.upsert(base.limit(0)) == []
    assert empty.upsert(base) == [0, 1, 2, 3] and rows(empty.rows) == rows(base)


def test_relations_are_replaced_at_both_ends(spark):
    rng = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a < b})
    edges = spark.createDataFrame([(a, b, rng.choice(["prequel", "sequel", "character"])) for a, b in pairs], "subject_id long, related_subject_id long, relation string")
    base = lookups.both_ways(edges, "subject_id", "related_subject_id", "relation", values.inverse_relation)
    table = PatchedTable(base, ["subject_id", "related_subject_id"], 16, by=["subject_id"])
    fresh = spark.createDataFrame([(2, 40, "prequel"), (2, 5, "sequel")], base.schema)
    subjects = spark.createDataFrame([(2,), (9,)], "id long")
    before = files_of(table)
    touched = patch_relations(table, fresh, subjects, values.inverse_relation)
    assert rows(table.rows) == rows(merge.replace_relations(base, fresh, subjects, values.inverse_relation).select(*base.columns))
    after = files_of(table)
    assert 0 < len(touched) < 16 and {b for b in before if before[b] != after.get(b)} <= set(touched)
