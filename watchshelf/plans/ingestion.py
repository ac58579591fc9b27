"""From landed feed records to clean tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import airing_status, cleaned_date, weekday
from ..functions.values import inverse_relation, positive_max
from ..operators.filters import safe_for_all
from ..operators.lookups import resolved
from ..operators.merge import replace_relations, upsert
from ..operators.paging import latest

ANIME = 2


def clean_subjects(feed: DataFrame, since: str | None = None) -> DataFrame:
    """Subjects of the feed in the catalog's columns: unsafe ones dropped, dates cleaned, 0 episodes as unknown."""
    rows = feed.filter(safe_for_all(F.col("nsfw")))
    if since:
        rows = rows.filter(F.coalesce("date", F.lit("")) >= since)
    day = cleaned_date(F.col("date"))
    return rows.select(
        F.col("id").alias("bangumi_id"), F.coalesce("name", F.lit("")).alias("name"), "name_cn", "summary", F.coalesce("type", F.lit(ANIME)).alias("type"), positive_max(F.col("eps"), F.col("total_episodes")).alias("eps"),
        "volumes", day.alias("air_date"), weekday(day).alias("air_weekday"), F.col("images.large").alias("image"), F.col("rating.score").alias("score"), F.col("rating.rank").alias("rank"),
        F.col("collection.collect").alias("collection_total"), F.lit(False).alias("nsfw"),
    )


def clean_tags(feed: DataFrame) -> DataFrame:
    """A row for each tag of each subject; of a tag named twice the last count holds."""
    rows = feed.select(F.col("id").alias("bangumi_id"), F.posexplode("tags").alias("place", "tag")).select("bangumi_id", "place", "tag.name", "tag.count")
    return latest(rows.filter("name IS NOT NULL"), ["bangumi_id", "name"], [F.col("place").desc()]).drop("place")


def clean_episodes(feed: DataFrame, subject_id: Column, as_of: date) -> DataFrame:
    day = cleaned_date(F.col("airdate"))
    return feed.select(
        subject_id.alias("subject_id"), F.col("id").alias("bangumi_ep_id"), F.coalesce("type", F.lit(0)).alias("type"), "sort", "name", "name_cn", "duration", day.alias("airdate"),
        F.col("desc").alias("description"), airing_status(day, as_of).alias("status"),
    )


def unseen(ids: DataFrame, subject: DataFrame) -> DataFrame:
    """The ids to fetch on a resumed run: those not imported yet."""
    return ids.join(subject.filter("import_status = 1").select("bangumi_id"), "bangumi_id", "left_anti")


def merged_subjects(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Subjects upserted on the feed's id; what was created stays so, fresh values hold even when null."""
    return upsert(base, fresh, ["bangumi_id"], keep=("id", "created_at"))


def merged_episodes(base: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(base, fresh, ["subject_id", "bangumi_ep_id"], keep=("id", "created_at"))


def merged_tags(base: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(base, fresh, ["subject_id", "name"], keep=("id",))


def merged_relations(base: DataFrame, feed: DataFrame, subject: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations with those of the feed's subjects replaced, both ways; and the feed's rows about subjects that are missing.

    feed: subject_id, id (the feed's id of the other), type, relation.
    """
    wanted = feed.filter(F.col("type") == ANIME).select("subject_id", F.col("id").alias("bangumi_id"), "relation")
    known, missing = resolved(wanted, subject.select("bangumi_id", F.col("id").alias("related_subject_id")), "bangumi_id", "related_subject_id")
    subjects = feed.select(F.col("subject_id").alias("id")).distinct()
    return replace_relations(base, known.select("subject_id", "related_subject_id", "relation"), subjects, inverse_relation), missing


def success_counts(runs: DataFrame) -> DataFrame:
    """How many items were imported and how many failed, each by its own count."""
    return runs.agg(F.count_if("ok").alias("imported"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("scanned"))
