"""Lookups and joins that keep an order, a default, or what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of up to so many keys is broadcast.
LISTED = 100_000


def all_of(links: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """The keys that are linked to every wanted value; a value asked for twice counts once."""
    values = sorted(set(wanted))
    return links.filter(F.col(value).isin(values)).groupBy(key).agg(F.count_distinct(value).alias("n")).filter(F.col("n") == len(values)).select(key)


def in_given_order(df: DataFrame, key: str, ids: list, numbered: bool = False) -> DataFrame:
    """The rows with these keys in the order of the list (the first place of a repeated one); misses are dropped. numbered: with the place in the list as position."""
    kind = df.schema[key].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{key} {kind}, position int")
    found = df.join(F.broadcast(wanted) if len(ids) <= LISTED else wanted, key).orderBy("position")
    return found if numbered else found.drop("position")


def ordered_lookup(links: DataFrame, df: DataFrame, on: str, key: str, position: str) -> DataFrame:
    """df's rows for links, in the order of the links' position; links without a row are dropped."""
    return links.select(F.col(on).alias(key), F.col(position).alias("__position")).join(df, key).orderBy("__position", key).drop("__position")


def with_default(left: DataFrame, right: DataFrame, on: str, values: list[str], default: int = 0) -> DataFrame:
    """A left join in which missing values are the default."""
    return left.join(right, on, "left").fillna(default, subset=values)


def split_known(df: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """df's rows whose keys are not known yet, and those whose keys are."""
    return df.join(known.select(*keys), keys, "left_anti"), df.join(known.select(*keys), keys, "left_semi")


def resolved(df: DataFrame, ids: DataFrame, foreign: str, local: str) -> tuple[DataFrame, DataFrame]:
    """df with its foreign key replaced by the local one of ids (foreign, local), and the rows that ids doesn't know."""
    return df.join(ids, foreign).drop(foreign), df.join(ids, foreign, "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, each as often as it is missing on the other, with the side; empty if both are the same."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def both_ways(edges: DataFrame, source: str, target: str, relation: str, inverse) -> DataFrame:
    """Every edge and its inverse, whose relation is inverse(relation); an edge that is there both ways comes once."""
    back = edges.select(F.col(target).alias(source), F.col(source).alias(target), inverse(F.col(relation)).alias(relation))
    return edges.select(source, target, relation).unionByName(back).distinct()
