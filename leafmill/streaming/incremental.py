"""Streams over the evidence tables and what is done step by step over tables that grow.

The functions take batch and streaming DataFrames alike, so that a query over a whole table and a stream over its
arriving files share one definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_chunks(chunks: DataFrame, time: str = "ingested_at", lateness: str = "7 days") -> DataFrame:
    """Each chunk id once. In a stream the ids of the last ``lateness`` are remembered; a batch keeps any one row."""
    if chunks.isStreaming:
        return chunks.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["chunk_id"])
    return chunks.dropDuplicates(["chunk_id"])


def event_windows(events: DataFrame, width: str = "1 hour", lateness: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, n, total) in windows of event time; in a stream late rows beyond ``lateness`` are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user no further apart than ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n, batches): how many rows of each key have come so far, kept as state and given whenever it changes."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, batches = state.get if state.exists else (0, 0)
        n, batches = n + sum(len(frame) for frame in frames), batches + 1
        state.update((n, batches))
        yield pd.DataFrame([(group[0], n, batches)], columns=["key", "n", "batches"])

    return stream.select(F.col(key).alias("key")).groupBy("key").applyInPandasWithState(update, "key string, n long, batches long", "n long, batches long", "update", GroupStateTimeout.NoTimeout)


def append_new(batch: DataFrame, target: str, key: str) -> int:
    """Append the rows of a batch whose key the target table doesn't have; running it again adds nothing. Returns the rows added."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    try:
        rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
    except Exception as error:  # noqa: BLE001 - the first batch has no target yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(target)
    rows.unpersist()
    return n


def sync_into(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended to a table by key; a batch that is run again after a failure adds nothing twice."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
