"""Keyword search by an inverted index of trigrams: equal to a scan for any keyword, but it reads the postings of a few trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .filters import contains

SIZE = 3


def grams(keyword: str) -> list[str]:
    """The distinct trigrams of a keyword, lower-cased; none if it is shorter."""
    text = keyword.lower()
    return sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})


class KeywordIndex:
    """Postings (gram, key) in folders by a hash of the gram.

    A keyword's trigrams are looked up, keys that have all of them are joined to the table, and what they name is checked
    exactly, since trigrams may stand apart. Keywords of fewer than three characters, which every index of trigrams
    lacks, are searched by a scan. Null names match nothing; keys are unique and not null. A trigram that most
    rows have is a column of keys, counted in parts before any shuffle.
    """

    def __init__(self, df: DataFrame, key: str, column: str, buckets: int = 64):
        self.df, self.key, self.column, self.buckets = df, key, column, buckets
        text = F.lower(column)
        starts = F.sequence(F.lit(1), F.length(text) - SIZE + 1)
        each = df.filter(F.length(text) >= SIZE).select(F.col(key), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(SIZE))))).alias("gram"))
        placed = each.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        self.postings = written(placed.repartition("bucket").sortWithinPartitions("bucket", "gram"), "keywords", "bucket")

    def matches(self, keyword: str) -> DataFrame:
        """The keys whose names have all trigrams of a keyword."""
        wanted = grams(keyword)
        spark = self.df.sparkSession
        # one number for each trigram of the keyword, so that the scan knows its folders
        asked = spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).alias("b")).distinct().collect()
        rows = self.postings.filter(F.col("bucket").isin([r["b"] for r in asked]) & F.col("gram").isin(wanted))
        return rows.groupBy(self.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(self.key)

    def search(self, keyword: str) -> DataFrame:
        """The table's rows whose column holds the keyword, whatever the case."""
        if keyword == "":
            return self.df.filter(F.col(self.column).isNotNull())
        found = self.df if len(keyword) < SIZE else self.df.join(self.matches(keyword), self.key, "left_semi")
        return found.filter(contains(keyword, F.col(self.column)))
