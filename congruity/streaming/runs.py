"""Streams over files that arrive, written as tables.

A run takes what is there and ends; the next one, with the same checkpoint, goes on from
it, with the state of joins and duplicates. The checkpoint and the table are in folders
that all executors share. A run that broke off is run again: its last batch is written
anew and no row twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import require


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """Files below ``path`` as they arrive, at most ``files`` to a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> int:
    """Appends the results of all that is there to a table, and returns how many batches
    that took."""
    require(df.isStreaming, "this is a table, not a stream")
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    query = (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return len(query.recentProgress)
