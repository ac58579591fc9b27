"""Places, running sums and maxima over all rows in one order, and pages at any depth, without a task that sees all rows.

Rows are written once in ranges of the order, each range a folder. Within a range a window runs as usual; what the
ranges before it add up to is carried into it by a table of one row for each range. So the work splits wherever the
order does, even among the rows of one hot key, and a page reads only the ranges that it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .filters import clamp
from .paging import PAGE_CAP

RANGE = "__range"


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df in that many ranges (spark.sql.shuffle.partitions unless given) of an order that ends in a key; the column __range grows with the order."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), "ranged", RANGE)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """rows (of ranged, or with its __range) with sums and maxima from the first row up to each row."""
    sums, maxes = sums or {}, maxes or {}
    upto = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(RANGE).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], *[F.max(c).alias(f"__{n}") for n, c in maxes.items()])
    carried = totals.select(RANGE, *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums], *[F.max(f"__{n}").over(earlier).alias(f"__{n}") for n in maxes])
    inside = rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.max(c).over(upto) for n, c in maxes.items()})
    whole = inside.join(F.broadcast(carried), RANGE)
    added = {n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"__{n}") for n in maxes}
    return whole.withColumns(added).drop(*[f"__{n}" for n in (*sums, *maxes)])


def strictly_increasing(df: DataFrame, stamp: str, order: list[str], name: str = "strict", ranges: int | None = None) -> DataFrame:
    """df with stamps in microseconds that grow from row to row: a stamp that isn't beyond the last one given is one more than it.

    Such a stamp less its row's place is the largest of all stamps so far, each less its place.
    """
    keys = [F.col(c) for c in order]
    placed = running(ranged(df, keys, ranges), keys, {"__place": F.lit(1)})
    behind = running(placed, keys, maxes={name: F.unix_micros(F.col(stamp).cast("timestamp")) - F.col("__place")})
    return behind.withColumn(name, F.col(name) + F.col("__place")).drop("__place", RANGE)


class Numbered:
    """A table laid out in an order that ends in a key. Its rows know their places, and a page, however deep, reads few ranges."""

    def __init__(self, df: DataFrame, order: list[Column], ranges: int | None = None):
        self.order, self.rows = order, ranged(df, order, ranges)
        #: Rows by range, one number for each.
        self.sizes = sorted(map(tuple, self.rows.groupBy(RANGE).count().collect()))

    def places(self, name: str = "place") -> DataFrame:
        """All rows with their places, from 1."""
        return running(self.rows, self.order, {name: F.lit(1)}).drop(RANGE)

    def page(self, number: int = 1, size: int = 20, cap: int = PAGE_CAP, name: str = "place") -> DataFrame:
        """One page with the places of its rows."""
        size = clamp(size, 1, cap)
        first, before, wanted, skip = (max(1, number) - 1) * size, 0, [], 0
        for at, n in self.sizes:
            if before < first + size and before + n > first:
                skip = skip if wanted else first - before
                wanted.append(at)
            before += n
        # a sorted page is one partition, so ids grow by one
        found = self.rows.filter(F.col(RANGE).isin(wanted)).orderBy(*self.order).offset(skip).limit(size)
        return found.withColumn(name, F.monotonically_increasing_id() + (first + 1)).drop(RANGE)
