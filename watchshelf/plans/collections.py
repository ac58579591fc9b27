"""Reads of users' collections and the weekly progress proposal."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season_of, season_range, week_so_far
from ..functions.values import COLLECTION_TYPES, display_name, label
from ..operators.aggregates import counts_by_key, last_whole
from ..operators.filters import ahead, any_weekday, equal, where
from ..operators.paging import page

OWN = ("id", "user_id", "subject_id", "type", "rate", "ep_status", "created_at", "updated_at")
SHOWN = ("name", "name_cn", "image", "score", "eps", "air_date", "air_weekday")
WATCHING, MAIN = 3, 0


def with_subjects(collection: DataFrame, subject: DataFrame) -> DataFrame:
    """Collections with what is shown of their subject; those without a subject are dropped."""
    shown = subject.select(F.col("id").alias("subject_id"), *[c for c in SHOWN if c in subject.columns], F.col("type").alias("subject_type"))
    return collection.select(*OWN).join(shown, "subject_id")


def nested(df: DataFrame) -> DataFrame:
    """The subject's columns as one struct."""
    columns = [c for c in df.columns if c not in OWN]
    return df.select(*OWN, F.struct(*columns).alias("subject"))


def collections(collection: DataFrame, subject: DataFrame, user_id: int | None = None, kind: int | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of a user's collections (of all users' if None), last changed first."""
    own = where(collection, [equal(F.col("user_id"), user_id), equal(F.col("type"), kind)])
    return page(with_subjects(own, subject), [F.col("updated_at").desc(), F.col("id").desc()], number, size)


def type_counts(collection: DataFrame) -> DataFrame:
    """Each user's number of collections by type, as a map."""
    return counts_by_key(collection, "user_id", "type")


def schedule(
    collection: DataFrame, subject: DataFrame, as_of: date, user_id: int | None = None, weekday: int | None = None, year: int | None = None, season: str | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    """A page of the season's subjects that a user collects, by weekday, then score."""
    first, last = season_range(*((year, season) if year and season else season_of(as_of)))
    own = where(collection, [equal(F.col("user_id"), user_id)])
    shown = where(subject, [F.col("air_date").between(F.lit(first), F.lit(last)), equal(F.col("air_weekday"), any_weekday(weekday))])
    return page(with_subjects(own, shown), [F.col("air_weekday").asc(), F.col("score").desc(), F.col("id")], number, size)


def one(collection: DataFrame, user_id: int, subject_id: int) -> DataFrame:
    return collection.filter((F.col("user_id") == user_id) & (F.col("subject_id") == subject_id))


def completes(target: Column, eps: Column) -> Column:
    return F.coalesce((eps > 0) & (target >= eps), F.lit(False))


def progress_candidates(collection: DataFrame, subject: DataFrame, episode: DataFrame, as_of: date, user_id: int | None = None, week: tuple[date, date] | None = None) -> DataFrame:
    """Collections being watched whose week has aired whole-numbered main episodes beyond their progress.

    The week runs from Monday to yesterday; on a Monday it is empty, and so is the result. Episodes are narrowed and
    reduced to one row per subject before they meet the collections.
    """
    first, last = week or week_so_far(as_of)
    aired = episode.filter((F.col("type") == MAIN) & F.col("airdate").between(F.lit(first), F.lit(last)))
    targets = aired.groupBy("subject_id").agg(last_whole(F.col("sort")).alias("target_ep_status")).filter("target_ep_status IS NOT NULL")
    own = where(collection, [equal(F.col("user_id"), user_id), F.col("type") == WATCHING]).select("user_id", "subject_id", F.col("ep_status").alias("current_ep_status"))
    names = subject.select(F.col("id").alias("subject_id"), display_name(F.col("name_cn"), F.col("name")).alias("subject_name"), F.col("eps").alias("total_episodes"))
    found = own.join(targets, "subject_id").filter(ahead(F.col("target_ep_status"), F.col("current_ep_status"))).join(names, "subject_id")
    return found.withColumn("completed", completes(F.col("target_ep_status"), F.col("total_episodes"))).orderBy("subject_id", "user_id")


def watch_profile(collection: DataFrame, subject: DataFrame, user_id: int, cap: int = 100, original_first: bool = True) -> DataFrame:
    """A user's last collections in short: name, type in words, rating (null if unrated) and progress."""
    rows = collections(collection, subject, user_id, size=cap)
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("name_cn")) if original_first else display_name(F.col("name_cn"), F.col("name"))
    return rows.select("subject_id", name.alias("name"), label(F.col("type"), COLLECTION_TYPES).alias("type"), F.nullif("rate", F.lit(0)).alias("rate"), "ep_status", "updated_at", "id")


def wishlist_plan(ids: DataFrame, collection: DataFrame, user_id: int, cap: int = 10) -> DataFrame:
    """The first distinct subject_ids (by position) with state: pending if the user lacks them, else skipped."""
    from ..operators.paging import first_seen

    asked = first_seen(ids.select("position", "subject_id"), "subject_id", "position").orderBy("position").limit(cap)
    own = collection.filter(F.col("user_id") == user_id).select("subject_id", F.lit("skipped").alias("state")).distinct()
    return asked.join(own, "subject_id", "left").fillna("pending", subset=["state"]).orderBy("position")
