"""Counts and sums of the dashboards."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import days, season_key
from .filters import clamp


def scalars(spark: SparkSession, counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each DataFrame; the counts are scalar subqueries of one plan."""
    return spark.range(1).select(*[df.agg(F.count("*").alias("n")).scalar().alias(name) for name, df in counts.items()])


def since(df: DataFrame, column: str, as_of: date) -> DataFrame:
    return df.filter(F.col(column) >= F.lit(as_of).cast("timestamp_ntz"))


def per_day(df: DataFrame, column: str, first: date, name: str = "n") -> DataFrame:
    """day and the number of rows since first."""
    return since(df, column, first).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias(name))


def daily_trends(spark: SparkSession, series: dict[str, tuple[DataFrame, str]], as_of: date, count: int, least: int = 1, most: int = 90) -> DataFrame:
    """A row for each of the last days to as_of with the count of each series (rows, time column); days without rows count 0."""
    count = clamp(count, least, most)
    first = as_of - timedelta(days=count - 1)
    out = days(spark, as_of, count)
    for name, (df, column) in series.items():
        out = out.join(per_day(df, column, first, name), "day", "left")
    return out.fillna(0, subset=list(series))


def counted(df: DataFrame, key: Column, name: str, count: str = "n") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias(count))


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """rate, the whole part of scores above 0, and how many have it."""
    return counted(df.filter(F.col(score) > 0), F.floor(score).cast("int"), "rate")


def season_counts(df: DataFrame, day: str) -> DataFrame:
    return counted(df.filter(F.col(day).isNotNull()), season_key(F.col(day)), "season_key")


def sum_if(condition: Column) -> Column:
    """How many rows meet the condition; 0 without rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def log_statistics(df: DataFrame) -> DataFrame:
    """total, success_count, failed_count and avg_duration_ms (a double; 0 without rows) of log rows. Cast, since some databases that get the aggregate average whole numbers to a whole number."""
    return df.agg(
        F.count("*").alias("total"), sum_if(F.col("status") == 0).alias("success_count"), sum_if(F.col("status") == 1).alias("failed_count"),
        F.coalesce(F.avg(F.col("duration_ms").cast("double")), F.lit(0.0)).alias("avg_duration_ms"),
    )


def most_frequent(facts: DataFrame, fact_key: str, items: DataFrame, key: str, columns: list[str], count: str = "n") -> DataFrame:
    """items' columns with how many facts point to each; facts are counted before the join, so that joins counts, not facts."""
    counts = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias(count))
    return items.select(key, *columns).join(counts, key)


def counts_by_key(df: DataFrame, owner: str, kind: str) -> DataFrame:
    """owner and a map from kind to its count."""
    parts = df.groupBy(owner, kind).agg(F.count("*").alias("n"))
    return parts.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def last_whole(value: Column) -> Column:
    """The largest whole number of a decimal column, fractions ignored."""
    return F.max(F.when(value == F.floor(value), value.cast("int")))
