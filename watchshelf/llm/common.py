"""Pieces that several of the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words wherever a contract speaks of `[^\x20\x09-\x0D]+`.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; in ASCII texts, which lower() handles faster, that is all it does."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text, in order, without empty strings (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), lambda w: w != "")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join on keys in which nulls equal each other; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def drawn(keys: DataFrame, key: str, most: int) -> DataFrame:
    """At most that many distinct keys that aren't null, the lowest by a hash; so few that they may be broadcast."""
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit("drawn")), key).limit(most)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Workspace:
    """Tables of one run in the shared folder: they cut lineage, and they outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        for made in _watchers:
            made.append(self)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df, in a folder for each value of a column if given, and reads it again; its shuffle files go as soon as it is written."""
        with setting(self.spark, _CLEANUP, "true"):
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all of them."""
        for at in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_watchers: list[list[Workspace]] = []


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables of all workspaces that are made inside, at the end; by then the results must be written elsewhere."""
    made: list[Workspace] = []
    _watchers.append(made)
    try:
        yield
    finally:
        _watchers.remove(made)
        for ws in made:
            ws.drop()


def per_batch(make: Callable[[list], object]) -> Callable:
    """For mapInArrow: make gets a batch's columns as lists and returns a record batch."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run
