"""Optional predicates: each applies only if its argument is there."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_bounds

#: Up to so many values an IN list stays a predicate that the scan can use; beyond that it becomes a semi join.
IN_LIST = 1000


def normalised(text: str | None) -> str | None:
    """Trimmed, and None if nothing is left."""
    return (text or "").strip() or None


def any_weekday(day: int | None) -> int | None:
    """-1 stands for any day."""
    return None if day in (None, -1) else between("weekday", day, 0, 6)


def between(name: str, value: int | float, low: int | float, high: int | float) -> int | float:
    if not low <= value <= high:
        raise ValueError(f"{name} is from {low} to {high}, not {value}")
    return value


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def where(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """df where all given conditions hold."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def equal(column: Column, value: object | None) -> Column | None:
    return None if value is None else column == value


def at_least(column: Column, value: object | None) -> Column | None:
    return None if value is None else column >= value


def at_most(column: Column, value: object | None) -> Column | None:
    return None if value is None else column <= value


def contains(keyword: str | None, *columns: Column, wildcards: bool = False) -> Column | None:
    """The keyword occurs in one of the columns, whatever the case; wildcards: % and _ in it stand for any text and character."""
    if keyword is None:
        return None
    if wildcards:
        pattern = "%" + keyword.lower().replace("\\", "\\\\") + "%"
        return reduce(Column.__or__, [F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in columns])
    return reduce(Column.__or__, [F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False)) for c in columns])


def in_year(column: Column, year: int | None) -> Column | None:
    """A date within the year, as a range that reaches the scan."""
    return None if year is None else column.between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31)))


def among(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values."""
    if len(values) <= IN_LIST:
        return df.filter(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(wanted, column, "left_semi")


def log_conditions(
    action: str | None = None, module: str | None = None, username: str | None = None, user_id: int | None = None, status: int | None = None, start: date | None = None, end: date | None = None
) -> list[Column | None]:
    """The filter that pages and statistics of the activity log share; start and end are whole days."""
    texts = [equal(F.col(n), normalised(v)) for n, v in (("action", action), ("module", module), ("username", username))]
    return [*texts, equal(F.col("user_id"), user_id), equal(F.col("status"), status), *day_bounds(F.col("created_at"), start, end)]


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row meets the condition; stops at the first."""
    return not df.filter(condition).limit(1).isEmpty()


def either(first: Column, second: Column) -> Column:
    return F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))


def safe_for_all(nsfw: Column) -> Column:
    """Not marked as unsafe; unmarked counts as safe."""
    return ~F.coalesce(nsfw, F.lit(False))


def ahead(target: Column, current: Column) -> Column:
    """The target lies beyond the current progress, none counting as 0."""
    return target > F.coalesce(current, F.lit(0))
