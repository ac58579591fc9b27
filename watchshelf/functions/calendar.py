"""Seasons, weeks, weekdays and days. Dates that stand for today are arguments, so results don't drift."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seasons in order, each three months from January on.
SEASONS = ("winter", "spring", "summer", "autumn")
#: The feed's own naming counts January to March as spring.
FEED_SEASONS = ("spring", "summer", "autumn", "winter")


def season_range(year: int, season: str) -> tuple[date, date]:
    """The first and last day of a season."""
    if season not in SEASONS:
        raise ValueError(f"a season is one of {', '.join(SEASONS)}")
    first = SEASONS.index(season) * 3 + 1
    after = date(year + first // 10, (first + 2) % 12 + 1, 1)
    return date(year, first, 1), after - timedelta(days=1)


def season_of(day: date) -> tuple[int, str]:
    return day.year, SEASONS[(day.month - 1) // 3]


def parse_season(text: str, names: tuple[str, ...] = SEASONS) -> tuple[int, str]:
    """(year, season) of `2026-summer`."""
    year, _, name = text.strip().lower().partition("-")
    if not year.isdigit() or name not in names:
        raise ValueError(f"not a season key: {text!r}")
    return int(year), SEASONS[names.index(name)]


def season_key(day: Column) -> Column:
    """`2026-summer` for a date column."""
    quarter = F.quarter(day)
    name = F.when(quarter == 1, SEASONS[0]).when(quarter == 2, SEASONS[1]).when(quarter == 3, SEASONS[2]).otherwise(SEASONS[3])
    return F.concat(F.year(day).cast("string"), F.lit("-"), name)


def weekday(day: Column) -> Column:
    """0 on Sunday to 6 on Saturday."""
    return F.dayofweek(day) - 1


def monday_first(day: Column) -> Column:
    """A weekday (0 on Sunday) counted from Monday."""
    return (day + 6) % 7


def week_so_far(as_of: date) -> tuple[date, date]:
    """Monday of the week and yesterday; on a Monday the second is before the first."""
    return as_of - timedelta(days=as_of.weekday()), as_of - timedelta(days=1)


def day_bounds(column: Column, start: date | None, end: date | None) -> list[Column]:
    """Conditions for whole days from start to end, both included, as a half-open range that pushes down."""
    lower = [column >= F.lit(start).cast("timestamp_ntz")] if start else []
    return lower + ([column < F.lit(end + timedelta(days=1)).cast("timestamp_ntz")] if end else [])


def days(spark: SparkSession, last: date, count: int) -> DataFrame:
    """A row for each of the count days that end with last."""
    span = F.sequence(F.lit(last - timedelta(days=count - 1)), F.lit(last))
    return spark.range(1).select(F.explode(span).alias("day"))


def cleaned_date(text: Column) -> Column:
    """A date from text such as 2024-1-2 or one with year, month and day signs; null if it isn't one."""
    plain = F.regexp_replace(F.translate(text, "年月/日", "---"), r"\s", "")
    return F.try_to_timestamp(plain, F.lit("yyyy-M-d")).cast("date")


def airing_status(day: Column, as_of: date) -> Column:
    """Air before as_of, Today on it, NA after it or without a date."""
    today = F.lit(as_of)
    return F.when(day < today, "Air").when(day == today, "Today").otherwise("NA")
