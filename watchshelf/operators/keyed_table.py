"""Tables laid out for their key: lookups read single buckets and row groups, joins on the key move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, written
from .lookups import in_given_order

#: Lists of up to so many keys are part of the scan's filter.
PRUNING = 1_000


class KeyedTable:
    """df in buckets by its key, each one file sorted by the key with a bloom filter on it.

    A bucket is one task of each join, so keys with more rows than an average bucket are kept apart, in plain files, as are
    rows without a key. There are fewer such keys than buckets, so the rows that a table of unique keys has
    for them are few enough to broadcast, always.
    """

    def __init__(self, df: DataFrame, key: str, buckets: int | None = None):
        """As many buckets as shuffle partitions unless given; tables to be joined need the same number."""
        spark = df.sparkSession
        self.key, self.buckets, self.kind = key, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), df.schema[key].dataType
        has_key = F.col(key).isNotNull()
        total = df.filter(has_key).count()
        each = df.filter(has_key).groupBy(key).agg(F.count("*").alias("__n"))
        most, hot = each.agg(F.max("__n"), F.collect_list(F.when(F.col("__n") > total / self.buckets, F.col(key)))).first()
        self.unique = (most or 0) <= 1
        self.hot = [] if self.unique else hot
        together = has_key & ~F.col(key).isin(self.hot) if self.hot else has_key
        name, bloom = f"keyed_{uuid.uuid4().hex[:12]}", {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(max(1, total // self.buckets))}
        writer = df.filter(together).repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key)
        writer.options(**bloom).option("path", fresh_path(spark, name)).format("parquet").saveAsTable(name)
        self.bucketed = spark.table(name)
        self.apart = written(df.filter(~F.coalesce(together, F.lit(False))), "keyed-apart")

    @property
    def rows(self) -> DataFrame:
        return self.bucketed.unionByName(self.apart)

    def lookup(self, ids: list, numbered: bool = False) -> DataFrame:
        """The rows with these keys in the order of the list, as lookups.in_given_order has them."""
        found = self.rows if set(ids) & set(self.hot) else self.bucketed
        return in_given_order(found.filter(F.col(self.key).isin(ids)) if len(ids) <= PRUNING else found, self.key, ids, numbered)

    def joined(self, other: KeyedTable, how: str = "inner") -> DataFrame:
        """An inner or left join to a table of unique keys, whose key column is dropped. Other columns need names of their own."""
        if not other.unique or how not in ("inner", "left"):
            raise ValueError("the other table's keys must be unique and the join inner or left")
        if (self.buckets, self.kind) != (other.buckets, other.kind):
            raise ValueError("both tables need the same number of buckets and one type of key")
        if clashing := set(self.bucketed.columns) & (set(other.bucketed.columns) - {other.key}):
            raise ValueError(f"both tables have {', '.join(sorted(clashing))}")
        few = other.bucketed.filter(F.col(other.key).isin(self.hot))  # at most one row for each hot key
        parts = [self._met(self.bucketed, other.bucketed, other.key, how), self._met(self.apart, F.broadcast(few), other.key, how)]
        return parts[0].unionByName(parts[1])

    def _met(self, left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
        return left.join(right, left[self.key] == right[key], how).drop(right[key])
