"""Bounded buffers: the newest rows per key, oldest dropped, as state of a stream.

A key is cut into slots by a hash of its row id, and every (key, slot) keeps the newest ``n``
rows, so a hot key is spread over ``slots`` state partitions and tasks.  The union of the slots
contains the newest ``n`` rows of the key; :func:`latest` takes exactly these from the state store
of the stream, so nothing is written besides the state, whose size does not grow with the batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from driftloom.operators.series import SeriesKey, newest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """List state with the newest ``n`` rows of one (key, slot); null times are the oldest."""

    def __init__(self, n: int, state_schema: str, columns: list[str], order: list[str], keys: list[str], ttl_seconds: float | None) -> None:
        self.n, self.state_schema, self.columns, self.keys = n, state_schema, columns, keys
        self.at = [columns.index(c) for c in order]
        self.ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.state_schema, self.ttl)

    def _age(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in self.at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, came = [tuple(r) for r in self.rows.get()], 0

        def incoming() -> Iterator[tuple]:
            nonlocal came
            for row in rows:
                came += 1
                yield tuple(row[c] for c in self.columns)

        kept = heapq.nlargest(self.n, chain(held, incoming()), key=self._age)  # never more than n rows in memory
        self.rows.put(kept)
        yield Row(**dict(zip(self.keys, key)), dropped=len(held) + came - len(kept))

    def close(self) -> None:
        pass


def buffered(
    stream: DataFrame, key: str, columns: list[str], order: list[str], n: int = 1000, slots: int = 16, ttl_seconds: float | None = None
) -> DataFrame:
    """The stream's buffer as state; emits how many rows each touched (key, slot) dropped.

    Rows leave the state ``ttl_seconds`` after they were last written, where given; Spark then plans
    batches without data as well, so such a stream runs on and is stopped, not drained.
    """
    ddl = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    slotted = stream.select(key, *columns).withColumn("slot", F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int"))
    return slotted.groupBy(key, "slot").transformWithState(
        statefulProcessor=_Newest(n, ", ".join(f"{c} {ddl[c]}" for c in columns), columns, order, [key, "slot"], ttl_seconds),
        outputStructType=f"{key} {ddl[key]}, slot int, dropped bigint",
        outputMode="Update",
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )


def keep_buffer(buffer: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Run the buffer for its state alone."""
    return buffer.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, checkpoint: str, key: str, order: list[str], n: int = 1000) -> DataFrame:
    """Exactly the newest ``n`` rows per key out of the state that the stream keeps under ``checkpoint``."""
    state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    held = "list_element"
    if "ttlExpirationMs" in state.schema[held].dataType.names:  # a state with expiry keeps rows one level deeper
        state = state.where(F.col(f"{held}.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
        held = f"{held}.value"
    rows = state.select(F.col(f"key.{key}").alias(key), f"{held}.*")
    return newest(rows, SeriesKey((key,), order[0], tuple(order[1:])), n)
