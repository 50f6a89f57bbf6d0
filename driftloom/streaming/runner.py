"""Run control: start, drain, run for a time, and the continuous generator."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from driftloom.operators.drift import drift
from driftloom.operators.generate import generate, generate_series
from driftloom.schema import TableSpec
from driftloom.streaming.sources import continuous_rows


def drain(writer: DataStreamWriter, timeout: float | None = None) -> StreamingQuery:
    """Process everything that is there now, then end."""
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream was not drained within {timeout} seconds")
    return query


def run_for(writer: DataStreamWriter, seconds: float, every_seconds: float = 1.0) -> StreamingQuery:
    """Run continuously for some seconds, then stop; failures of the query are raised."""
    query = writer.trigger(processingTime=f"{every_seconds} seconds").start()
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
    return query


def drift_event(batch_id: int, batch_seconds: float, drift_seconds: float) -> int | None:
    """Number of the drift event that falls on a micro-batch, or None.

    Micro-batch k stands for the time ``k * batch_seconds`` of the run; a batch drifts when at
    least ``drift_seconds`` have passed since the last one that did.
    """
    every = max(1, math.ceil(drift_seconds / batch_seconds))
    return batch_id // every if batch_id > 0 and batch_id % every == 0 else None


def continuous_generator(
    spark: SparkSession,
    spec: TableSpec,
    batch_size: int,
    checkpoint: str,
    emit: Callable[[DataFrame, int], None],
    start: Any = "2024-01-01",
    batch_seconds: float = 1.0,
    drift_seconds: float | None = None,
    magnitude: float = 0.1,
) -> DataStreamWriter:
    """Endless generation: every micro-batch is one generated (sometimes drifted) batch.

    Rows follow from their ids and drift from the batch number, so a restart continues where the
    checkpoint ends and repeats a batch exactly.
    """
    rows = continuous_rows(spark, batch_size)

    def each(batch: DataFrame, batch_id: int) -> None:
        keep = ["row_id"]
        made = (
            generate(batch, spec, keep=keep)
            if spec.time_field is None
            else generate_series(batch, spec, start, batch_size, keep=keep)
        )
        event = None if drift_seconds is None else drift_event(batch_id, batch_seconds, drift_seconds)
        if event is not None:
            made = drift(made, spec, magnitude, event=event)
        made = made.withColumns({"generator": F.lit(spec.name), "drifted": F.lit(event is not None)})
        emit(made, batch_id)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
