"""Readers. Feeds are fetched by other programs and land as JSON; Spark reads what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schema import FEEDS, TABLES


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A table of a database, read by ranges of its key over that many connections; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, fetchsize=10_000)
    return reader.options(**options).load()


#: Databases whose dialects write limits. For others Spark takes a pushed limit for done although the query it sends has none.
LIMITING = ("mysql", "postgresql", "h2", "sqlserver", "oracle", "db2", "databricks", "snowflake")


def jdbc_catalog(spark: SparkSession, name: str, url: str, **options: str) -> None:
    """Makes a database's tables known as name.schema.table. Filters, groups, aggregates and, where its dialect has them, sorted limits and offsets over them run in the database, so a page or a dashboard fetches its own rows only; whole tables are read faster by jdbc_table."""
    at, limits = f"spark.sql.catalog.{name}", str(url.split(":")[1] in LIMITING).lower()
    spark.conf.set(at, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in {"url": url, "pushDownAggregate": "true", "pushDownLimit": limits, "pushDownOffset": limits, **options}.items():
        spark.conf.set(f"{at}.{key}", value)


def landed(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """A feed's landed JSON under its fixed schema (no inference pass; broken records are null columns)."""
    return spark.read.schema(FEEDS[feed]).json(path)


def landed_browse(spark: SparkSession, path: str) -> DataFrame:
    """A row for each item of landed browse pages, with the year and month that the folders are partitioned by, if any."""
    pages = landed(spark, path, "browse")
    by = [c for c in ("year", "month") if c in pages.columns]
    return pages.select(*by, F.explode("data").alias("item")).select(F.col("item.id").alias("bangumi_id"), F.col("item.date").alias("date"), *by)


def landed_search(spark: SparkSession, path: str) -> DataFrame:
    """A row for each item of landed search results, with the number that matched in all."""
    return landed(spark, path, "search").select("total", F.explode("data").alias("item")).select(F.col("item.id").alias("bangumi_id"), "item.name", "item.name_cn", "item.date", "total")


def landed_calendar(spark: SparkSession, path: str) -> DataFrame:
    """day, place and id of weekly calendars: one JSON array for each file, whose order is that of the days; with the station that folders are partitioned by, if any."""
    files = spark.read.text(path, wholetext=True)
    by = [c for c in ("station",) if c in files.columns]
    weeks = files.select(*by, F.from_json("value", f"array<struct<{FEEDS['calendar'].replace(' ', ':', 1)}>>").alias("days"))
    days = weeks.select(*by, F.posexplode("days").alias("day", "items"))
    return days.select(*by, "day", F.posexplode("items.items").alias("place", "item")).select(*by, "day", "place", F.col("item.id").alias("bangumi_id"))


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """The insert sink: rows are added, by the day or another partition column if given."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a table; missing nullable columns are null."""
    fields = StructType.fromDDL(TABLES[name])
    missing = [f.name for f in fields if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return df.select(*[(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
