"""Reads of the catalog: lists, search, seasons, schedule, details, episodes and tags."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import airing_status, season_of, season_range
from ..operators.aggregates import counted
from ..operators.filters import any_weekday, at_least, at_most, between, contains, equal, in_year, normalised, where
from ..operators.lookups import all_of, ordered_lookup
from ..operators.paging import order, page, page_with_total, relevance

LIST_COLUMNS = ("id", "name", "name_cn", "image", "score", "rank", "eps", "air_date", "air_weekday", "type", "collection_total")


def list_items(df: DataFrame) -> DataFrame:
    """What a list shows of a subject: the columns above that the table has."""
    return df.select(*[c for c in LIST_COLUMNS if c in df.columns])


def subjects(subject: DataFrame, number: int = 1, size: int = 20, sort: str | None = None, direction: str | None = None) -> DataFrame:
    """A page of all subjects with the total."""
    return page_with_total(list_items(subject), [order(sort, direction), F.col("id")], number, size)


def searched(
    subject: DataFrame, tag: DataFrame | None = None, q: str | None = None, tags: list[str] | None = None, score_min: float | None = None, score_max: float | None = None, year: int | None = None,
    weekday: int | None = None, wildcards: bool = False,
) -> DataFrame:
    """The subjects that meet all given conditions; tags must all be there."""
    for name, score in (("score_min", score_min), ("score_max", score_max)):
        if score is not None:
            between(name, score, 0, 10)
    keyword = normalised(q)
    found = where(subject, [
        contains(keyword, F.col("name"), F.col("name_cn"), wildcards=wildcards), at_least(F.col("score"), score_min), at_most(F.col("score"), score_max), in_year(F.col("air_date"), year),
        equal(F.col("air_weekday"), any_weekday(weekday)),
    ])
    if tags:
        found = found.join(all_of(tag, "subject_id", "name", tags).withColumnRenamed("subject_id", "id"), "id", "left_semi")
    return found


def search(subject: DataFrame, tag: DataFrame | None = None, number: int = 1, size: int = 20, sort: str | None = None, direction: str | None = None, q: str | None = None, **filters) -> DataFrame:
    """A page of the search; sorted by score, subjects whose localized name holds the keyword come first."""
    keys, keyword = [order(sort, direction), F.col("id")], normalised(q)
    if keyword and (sort or "score") not in ("date", "rank", "collectionTotal"):
        keys = [relevance(contains(keyword, F.col("name_cn"))), *keys]
    return page(list_items(searched(subject, tag, q=q, **filters)), keys, number, size)


def by_season(subject: DataFrame, year: int, season: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of a season's subjects, best score first."""
    first, last = season_range(year, season)
    return page(list_items(subject.filter(F.col("air_date").between(F.lit(first), F.lit(last)))), [F.col("score").desc(), F.col("id")], number, size)


def schedule(subject: DataFrame, as_of: date, weekday: int | None = None, year: int | None = None, season: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of a season's subjects (the current one unless both are given) by weekday, then score."""
    first, last = season_range(*((year, season) if year and season else season_of(as_of)))
    found = where(subject, [F.col("air_date").between(F.lit(first), F.lit(last)), equal(F.col("air_weekday"), any_weekday(weekday))])
    return page(list_items(found), [F.col("air_weekday").asc(), F.col("score").desc(), F.col("id")], number, size)


def detail(subject: DataFrame, tag: DataFrame, relation: DataFrame, subject_id: int) -> DataFrame:
    """One row with the subject, its tags (most used first) and its relations with what a list shows of them."""
    one = subject.filter(F.col("id") == subject_id)
    tags = tag.filter(F.col("subject_id") == subject_id).select(F.struct((-F.col("count")).alias("rank"), "name", "count").alias("t"))
    own = relation.filter(F.col("subject_id") == subject_id).select(F.col("related_subject_id").alias("id"), "relation")
    related = own.join(list_items(subject), "id").select(F.struct("id", "relation", "name", "name_cn", "score").alias("r"))
    listed = tags.agg(F.array_sort(F.collect_list("t")).alias("ts")).select(F.transform("ts", lambda t: F.struct(t["name"].alias("name"), t["count"].alias("count"))).alias("tags"))
    return one.select("*", listed.scalar().alias("tags"), related.agg(F.array_sort(F.collect_list("r"))).scalar().alias("relations"))


def episodes(episode: DataFrame, subject_id: int, as_of: date) -> DataFrame:
    """The subject's episodes in order, with the status computed anew."""
    return episode.filter(F.col("subject_id") == subject_id).withColumn("status", airing_status(F.col("airdate"), as_of)).orderBy("sort", "id")


def tags(tag: DataFrame) -> DataFrame:
    """How many subjects have each tag, most frequent first."""
    return counted(tag, F.col("name"), "name", "count").select(F.lit(None).cast("long").alias("id"), "name", "count").orderBy(F.col("count").desc(), "name")


def subjects_by_tag(subject: DataFrame, tag: DataFrame, name: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of the subjects that have a tag, in the order in which they were tagged."""
    links = page(tag.filter(F.col("name") == name).select("id", "subject_id"), [F.col("id")], number, size)
    return ordered_lookup(links, list_items(subject), "subject_id", "id", "id")


def popular(subject: DataFrame, size: int = 10) -> DataFrame:
    return page(list_items(subject), [order("collectionTotal", "desc"), F.col("id")], 1, size)


def top_rated(subject: DataFrame, size: int = 10) -> DataFrame:
    return page(list_items(subject), [order("score", "desc"), F.col("id")], 1, size)
