"""Bars of a running stream by event time.

A watermark bounds the state: bars older than it are final and leave the state, and what still
comes for them is not used.  The stream reports how much that was, so late data is never lost
silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from driftloom.functions.scalars import micros_of, ntz_of
from driftloom.operators.series import SeriesKey


def bars(stream: DataFrame, key: SeriesKey, value: str, volume: Column, width: str, delay: str) -> DataFrame:
    """Open, high, low, close and volume per series and tumbling window of ``width``, as a streaming aggregate.

    ``delay`` is how far behind the newest event time a row may come.  The aggregates combine before
    the shuffle, and the state has one row per series and open window.
    """
    order = F.struct(*key.order)
    # a watermark needs a time with a zone; zone-less times count as UTC, whatever the session zone
    timed = stream.withColumn("_event", F.timestamp_micros(micros_of(F.col(key.ts))))
    grouped = timed.withWatermark("_event", delay).groupBy(*key.keys, F.window("_event", width).alias("_window"))
    made = grouped.agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.sum(volume).alias("volume"))
    return made.select(*key.keys, ntz_of(F.unix_micros("_window.start")).alias("bucket"), "open", "high", "low", "close", "volume")


def keep_bars(made: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the bars that each micro-batch changed under ``path``, one folder each, so a replay overwrites itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")

    return made.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)


def current_bars(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of every bar."""
    table = spark.read.parquet(path)
    names = [*keys, "bucket"]
    rest = [c for c in table.columns if c not in (*names, "snapshot")]
    best = table.groupBy(*names).agg(F.max_by(F.struct(*rest), "snapshot").alias("_row"))
    return best.select(*names, *[F.col(f"_row.{c}").alias(c) for c in rest])


def late_groups(query: StreamingQuery) -> int:
    """How many (series, window) groups of micro-batches came behind the watermark and were not used.

    Spark counts late data after it has combined the rows of a task by series and window, so this is
    a number of groups, at most that of the late rows and zero exactly when there were none.
    """
    progress = query.recentProgress
    if progress and progress[0]["batchId"] > 0:
        raise ValueError("older progress is gone; raise spark.sql.streaming.numRecentProgressUpdates")
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
