"""Tables on disk in buckets by a hash of their keys, whose merges rewrite only the buckets in which something changes.

The functions of merge.py give whole new snapshots. Here the buckets that changes can meet are known by their hash, those
where a value really differs are found by a join of these alone, and only they are written: first to a folder of
their own, then over the old ones. If that last step is lost on its way, nothing is: the patch is whole in its folder
and puts the same rows in place however often it is written. Buckets are folders of any number of files, so one
that holds a hot key is written by several tasks. DataFrames taken from a table are out of date after a change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.scratch import fresh_path, written
from .lookups import both_ways
from .merge import one_each, replace_relations, upsert

BUCKET = "__bucket"


class PatchedTable:
    def __init__(self, df: DataFrame, keys: list[str], buckets: int | None = None, by: list[str] | None = None):
        """keys are unique; by: those of them that tell the bucket (all unless given). As many buckets as shuffle partitions unless given."""
        self.spark, self.keys, self.by, self.columns = df.sparkSession, keys, by or keys, df.columns
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.types = {f.name: f.dataType for f in df.schema}
        self.schema = StructType([*df.schema.fields]).add(BUCKET, IntegerType())
        self.path = fresh_path(self.spark, "patched")
        self._dealt(self._placed(df)).write.partitionBy(BUCKET).parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def upsert(self, changes: DataFrame, keep: tuple[str, ...] = (), partial: bool = False, unique: bool = False) -> list[int]:
        """Puts changes in as merge.upsert does; returns the buckets written. Changes that change nothing write nothing."""
        fresh = written(self._placed(changes if unique else one_each(changes, self.keys)), "changes")
        supplied, keys = [c for c in changes.columns if c not in self.keys], [BUCKET, *self.keys]
        before = self._stored(self._numbers(fresh)).select(*keys, *[F.col(c).alias(f"__{c}") for c in supplied], F.lit(True).alias("__known"))

        def merged(c: str) -> Column:
            return F.coalesce(f"__{c}", c) if c in keep else F.coalesce(c, f"__{c}") if partial else F.col(c)

        differs = F.col("__known").isNull()
        for c in supplied:
            differs = differs | ~merged(c).eqNullSafe(F.col(f"__{c}"))
        touched = self._numbers(fresh.join(before, keys, "left").filter(differs))
        return self._replace(touched, upsert(self._stored(touched), fresh.filter(F.col(BUCKET).isin(touched)), keys, keep, partial, unique=True))

    def delete(self, gone: DataFrame) -> list[int]:
        """Deletes rows by key; returns the buckets that held any."""
        keys = [BUCKET, *self.keys]
        fresh = written(self._placed(gone.select(*self.keys)), "gone")
        touched = self._numbers(self._stored(self._numbers(fresh)).join(fresh, keys, "left_semi"))
        return self._replace(touched, self._stored(touched).join(fresh, keys, "left_anti"))

    def rewrite(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Changes all rows of the buckets of ids (with the columns of by) at once; what comes out must belong to these buckets."""
        touched = self._numbers(self._placed(ids.select(*self.by)))
        return self._replace(touched, self._placed(change(self._stored(touched).drop(BUCKET))))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with their buckets. An int and a long of one value hash differently, so columns take the table's types first."""
        rows = rows.select(*[F.col(c).cast(self.types[c]).alias(c) for c in rows.columns])
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.by)

    def _stored(self, numbers: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(self.schema).parquet(self.path)
        return found if numbers is None else found.filter(F.col(BUCKET).isin(numbers))

    @staticmethod
    def _numbers(rows: DataFrame) -> list[int]:
        """The buckets that rows lie in: no more numbers than the table has buckets."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _replace(self, touched: list[int], rows: DataFrame) -> list[int]:
        if touched:
            patch = written(self._dealt(rows.select(*self.columns, BUCKET)), "patch", BUCKET)
            patch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
            for number in set(touched) - set(self._numbers(patch)):  # buckets left without rows
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={number}")
                folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        return touched


def patch_relations(table: PatchedTable, fresh: DataFrame, subjects: DataFrame, inverse) -> list[int]:
    """merge.replace_relations on a table in buckets by subject_id that holds every relation both ways.

    The subjects' own rows name the others whose rows point back, so the buckets to write are known from theirs.
    """
    ids = subjects.select(F.col("id").alias("subject_id"))
    edges = written(both_ways(fresh, "subject_id", "related_subject_id", "relation", inverse), "edges")
    others = table._stored(table._numbers(table._placed(ids))).join(ids.distinct(), "subject_id", "left_semi").select(F.col("related_subject_id").alias("subject_id"))
    met = written(ids.unionByName(others).unionByName(edges.select("subject_id")).distinct(), "met")
    return table.rewrite(met, lambda rows: replace_relations(rows, fresh, subjects, inverse))
