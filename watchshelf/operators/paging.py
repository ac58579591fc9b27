"""Sorting by a fixed set of columns, pages, totals and the top of a ranking. Every order ends in a key, so pages never overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import clamp

PAGE_CAP = 100
#: What a reader may sort by, with the columns that they name.
SORTS = {"score": "score", "date": "air_date", "rank": "rank", "collectionTotal": "collection_total"}


def order(sort: str | None, direction: str | None, sorts: dict[str, str] = SORTS, default: str = "score") -> Column:
    """The column to sort by: unknown names give the default, anything but asc is descending."""
    column = F.col(sorts.get(sort or "", sorts[default]))
    return column.asc() if (direction or "").lower() == "asc" else column.desc()


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = 20, cap: int = PAGE_CAP) -> DataFrame:
    """One page in that order; a page past the end is empty."""
    size = clamp(size, 1, cap)
    return df.orderBy(*keys).offset((max(1, number) - 1) * size).limit(size)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None = None, size: int = 20, cap: int = PAGE_CAP) -> DataFrame:
    """The page that follows the row with those values of the keys (name, ascending), the first if None.

    Unlike an offset it skips nothing: the condition reaches the scan, and however deep the page only its own rows are kept.
    Keys aren't null; the last is unique.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, ascending), value in zip(keys, after, strict=True):
            beyond = beyond | (equal & (F.col(name) > value if ascending else F.col(name) < value))
            equal = equal & (F.col(name) == value)
        df = df.filter(beyond)
    return df.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in keys]).limit(clamp(size, 1, cap))


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """A page's rows, PAGE_CAP at most, with their number in its order, from 1. For more rows see operators.ordered."""
    # a limited sort is one partition, so ids grow by one
    return df.limit(PAGE_CAP).withColumn(name, F.monotonically_increasing_id() + 1)


def total(df: DataFrame) -> DataFrame:
    """The number of rows before paging, as one row."""
    return df.agg(F.count("*").alias("total"))


def page_with_total(df: DataFrame, keys: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page whose rows carry the total; counted by its own aggregation, not by a window over all rows."""
    return page(df, keys, number, size).withColumn("total", total(df).scalar())


def top(df: DataFrame, keys: list[Column], count: int, most: int = 50) -> DataFrame:
    return df.orderBy(*keys).limit(clamp(count, 1, most))


def relevance(match: Column) -> Column:
    """0 for rows that match and 1 for others, to sort matches first."""
    return F.when(F.coalesce(match, F.lit(False)), 0).otherwise(1)


def latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key's row of the smallest position; combined before the shuffle, so a frequent key is no burden."""
    whole = F.struct(position, *[c for c in df.columns if c != position])
    return df.groupBy(F.col(key).alias("__key")).agg(F.min(whole).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in df.columns])
