"""The dashboard's reads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import counted, daily_trends, most_frequent, score_histogram, season_counts, scalars, since, sum_if
from ..operators.paging import top


def logins(log: DataFrame, action: str = "LOGIN") -> DataFrame:
    return log.filter((F.col("action") == action) & (F.col("status") == 0))


def overview(spark: SparkSession, user: DataFrame, subject: DataFrame, collection: DataFrame, episode: DataFrame, record: DataFrame, log: DataFrame, as_of: date, login: str = "LOGIN") -> DataFrame:
    """Totals of the tables and what came today, in one row."""
    return scalars(spark, {
        "user_count": user, "subject_count": subject, "collection_count": collection, "episode_count": episode, "import_count": record, "today_new_users": since(user, "created_at", as_of),
        "today_new_collections": since(collection, "created_at", as_of), "today_logins": since(logins(log, login), "created_at", as_of),
    })


def trends(spark: SparkSession, user: DataFrame, collection: DataFrame, log: DataFrame, as_of: date, days: int = 30, login: str = "LOGIN") -> DataFrame:
    """New users, new collections and logins of each day, zeros included; days is kept within 1 and 90."""
    series = {"new_users": (user, "created_at"), "new_collections": (collection, "created_at"), "logins": (logins(log, login), "created_at")}
    return daily_trends(spark, series, as_of, days)


def collection_types(collection: DataFrame) -> DataFrame:
    return counted(collection, F.col("type"), "type").orderBy("type")


def ratings(collection: DataFrame) -> DataFrame:
    return counted(collection.filter("rate > 0"), F.col("rate"), "rate").orderBy("rate")


def collection_stats(collection: DataFrame) -> dict[str, DataFrame]:
    return {"types": collection_types(collection), "ratings": ratings(collection)}


def scores(subject: DataFrame) -> DataFrame:
    return score_histogram(subject, "score").orderBy("rate")


def seasons(subject: DataFrame) -> DataFrame:
    return season_counts(subject, "air_date").orderBy(F.col("season_key").desc())


def import_states(subject: DataFrame) -> DataFrame:
    return counted(subject, F.col("import_status"), "import_status").orderBy("import_status")


def import_totals(record: DataFrame) -> DataFrame:
    return record.agg(F.count("*").alias("import_total"), sum_if(F.col("status") == "COMPLETED").alias("import_succeeded"), sum_if(F.col("status") == "FAILED").alias("import_failed"))


def subject_stats(subject: DataFrame, record: DataFrame) -> dict[str, DataFrame]:
    return {"scores": scores(subject), "seasons": seasons(subject), "states": import_states(subject), "imports": import_totals(record)}


def hot(collection: DataFrame, subject: DataFrame, limit: int = 10) -> DataFrame:
    """The subjects in most collections; the limit is kept within 1 and 50."""
    counts = most_frequent(collection, "subject_id", subject, "id", ["name", "name_cn"], "collection_count")
    return top(counts, [F.col("collection_count").desc(), F.col("id")], limit)
