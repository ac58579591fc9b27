"""A given table in a database: what runs there, by the plan, and the same results as over the files."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from watchshelf.operators import filters, paging
from watchshelf.plans import activity
from watchshelf.sources import readers
from watchshelf.views import view

from conftest import DATA

URL, DRIVER = "jdbc:derby:memory:shelf;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def tables(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans tell all that is pushed down
    files = {n: view(spark, str(DATA), n) for n in ("operation_log", "user_collection")}
    readers.jdbc_catalog(spark, "shelf", URL, driver=DRIVER)
    found = {}
    for name, df in files.items():
        df = df.select("id", "action", "module", "status", "duration_ms", F.col("created_at").cast("timestamp_ntz").alias("created_at")) if name == "operation_log" else df.select("id", "subject_id", "type", "rate")
        sizes = ", ".join(f"{c} VARCHAR(100)" for c, kind in df.dtypes if kind == "string")
        df.write.format("jdbc").options(url=URL, driver=DRIVER, dbtable=name, **({"createTableColumnTypes": sizes} if sizes else {})).mode("overwrite").save()
        found[name] = (df, spark.table(f"shelf.APP.{name.upper()}"))
    yield found
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_statistics_run_in_the_database(tables):
    df, there = tables["operation_log"]
    asked = {"action": "VIEW", "start": date(2024, 1, 5), "end": date(2024, 1, 15)}
    found = activity.log_stats(there, **asked)
    assert found.collect() == activity.log_stats(df, **asked).collect()
    plan = plan_of(found)
    assert "PushedAggregates: [COUNT(*), SUM(CASE WHEN" in plan and "AVG(CAST(duration_ms" in plan and "action = 'VIEW'" in plan and "Aggregate(" not in plan and "Exchange" not in plan, plan


def test_a_ranking_runs_in_the_database(tables):
    df, there = tables["user_collection"]
    ranked = lambda x: paging.top(x.groupBy("subject_id").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("subject_id")], 5)
    assert ranked(there).collect() == ranked(df).collect()
    plan = plan_of(ranked(there))
    assert "PushedGroupByExpressions: [subject_id]" in plan and "PushedAggregates: [COUNT(*)]" in plan and "Exchange" not in plan


def test_a_page_sends_its_filter_and_columns(tables):
    df, there = tables["operation_log"]
    page = lambda x: activity.logs(x, 3, 20, status=1)
    assert page(there).collect() == page(df).collect()
    plan = plan_of(page(there))
    assert "status = 1" in plan and "TakeOrderedAndProject(limit=60" in plan


def test_a_keyset_page_reaches_the_database(tables):
    df, there = tables["user_collection"]
    page = lambda x: paging.page_after(x, [("rate", False), ("id", True)], (5, 100))
    assert page(there).collect() == page(df).collect()
    assert "rate < 5" in plan_of(page(there))


def test_limits_are_pushed_where_the_dialect_writes_them(spark):
    """This database's doesn't: Spark would drop the limit, so it must not be pushed."""
    for name, url, pushed in (("derby_like", URL, "false"), ("mysql_like", "jdbc:mysql://host/shelf", "true")):
        readers.jdbc_catalog(spark, name, url)
        assert spark.conf.get(f"spark.sql.catalog.{name}.pushDownLimit") == spark.conf.get(f"spark.sql.catalog.{name}.pushDownOffset") == pushed


def test_parallel_reads_by_ranges_of_the_key(spark, tables):
    df, _ = tables["user_collection"]
    read = readers.jdbc_table(spark, URL, "user_collection", "id", (0, 6000), 4, driver=DRIVER).select("id", "rate").filter("rate > 5")
    assert read.rdd.getNumPartitions() == 4 and sorted(read.collect()) == sorted(df.select("id", "rate").filter("rate > 5").collect())
    assert "PushedFilters: [*IsNotNull(rate), *GreaterThan(rate,5)]" in plan_of(read)


def test_existence_and_bounds(tables):
    _, there = tables["operation_log"]
    assert filters.exists(there, F.col("action") == "LOGIN") and not filters.exists(there, F.col("action") == "nothing")
    assert filters.between("score", 10, 0, 10) == 10
    for wrong in (-1, 11):
        with pytest.raises(ValueError, match="score"):
            filters.between("score", wrong, 0, 10)
