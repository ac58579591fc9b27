"""Event-time counts and retention of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """day, keys and n; a day is final once the watermark has passed it, and rows that come later are left out."""
    day = F.window("__time", "1 day")
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return timed.groupBy(day.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *keys, "n")


def recent_only(events: DataFrame, time: str, late: str) -> DataFrame:
    """Drops repeats of an event_id within the watermark."""
    return events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late).dropDuplicatesWithinWatermark(["event_id"]).drop("__time")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there now to a folder and ends; run again it takes only what is new."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
