"""Structured Streaming companions; each function takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_deliveries(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each delivery once. On a stream the state is bounded: a repeat that is later than ``late`` may come again."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def debounce(events: DataFrame, key: str, gap: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): bursts of events of a key, ended by a pause of ``gap``."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    burst = stamped.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return burst.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Writes everything that has arrived and stops; the next call goes on where this one ended, also after a failure.

    ``write`` gets a batch with its number and must be idempotent for that number.
    """
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
