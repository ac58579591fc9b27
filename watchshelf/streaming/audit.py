"""The audit log as a stream: finished calls become log rows, each batch of them written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.activity import audit_rows


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Writes a batch to a folder of its own and replaces what an attempt that broke off may have left there; other batches' folders stay."""
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def drain_once(stream: DataFrame, path: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame] = audit_rows, write: Callable[[DataFrame, int, str], None] = write_batch) -> StreamingQuery:
    """Appends what is there now and ends.

    After a failure the same batch runs again, with the same rows under the same number, since the checkpoint has both;
    so none is lost and none is there twice.
    """
    each = lambda batch, batch_id: write(rows_of(batch), batch_id, path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
