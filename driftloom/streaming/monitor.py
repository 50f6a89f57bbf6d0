"""Monitoring of running streams."""

from __future__ import annotations

import threading
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

METRIC_SCHEMA = "label string, batch_id bigint, rows bigint, seconds double, rows_per_second double"


def monitor_counts(stream: DataFrame, streamer: Column, ts: str) -> DataFrame:
    """Per streamer and data type: rows, errors and last time, as a streaming aggregate.

    The state is one row per (streamer, data type); partial sums combine before the shuffle.
    """
    return stream.groupBy(streamer.alias("streamer"), "data_type").agg(
        F.count("*").alias("data_points"),
        F.count_if(F.col("reason") == "error").alias("errors"),
        F.max(ts).alias("last_data_time"),
    )


def snapshots(counts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the counts that each micro-batch changed under ``path``; the newest row of a key is current."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every streamer and data type."""
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in ("streamer", "data_type", "snapshot")]
    best = table.groupBy("streamer", "data_type").agg(F.max_by(F.struct(*rest), "snapshot").alias("_row"))
    return best.select("streamer", "data_type", "_row.*")


class ProgressLog(StreamingQueryListener):
    """Collects one metric row per micro-batch of every query and flushes them to a table."""

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 100) -> None:
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self._rows: list[tuple[Any, ...]] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        seconds = float(p.batchDuration) / 1000.0
        row = (p.name or str(p.id), p.batchId, p.numInputRows, seconds, p.numInputRows / max(seconds, 1e-3))
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= self.flush_every
        if full:
            self.flush()

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def pending(self) -> int:
        return len(self._rows)

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def metrics(progress: DataFrame) -> DataFrame:
    """Throughput and latency per label."""
    return progress.groupBy("label").agg(
        F.count("*").alias("batches"),
        F.sum("rows").alias("records"),
        F.sum("seconds").alias("seconds"),
        F.percentile_approx("seconds", 0.5).alias("median_seconds"),
        F.percentile_approx("seconds", 0.95).alias("p95_seconds"),
    )
