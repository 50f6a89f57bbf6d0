"""One stream into several sinks and listeners, with a status row for each."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from driftloom.sinks.writers import kafka_payload, show, write_files

log = logging.getLogger(__name__)

STATUS_SCHEMA = "batch_id bigint, sink string, ok boolean, error string"


@dataclass(frozen=True)
class Sink:
    """A named target; ``write(batch, batch_id)`` may be any function (a custom sink).

    ``generators`` restricts the sink to rows of these generators.
    """

    name: str
    write: Callable[[DataFrame, int], None]
    generators: tuple[str, ...] | None = None


def files(name: str, path: str, fmt: str = "parquet", generators: tuple[str, ...] | None = None) -> Sink:
    """File sink with one folder per micro-batch: a replay overwrites its own folder only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_files(batch, f"{path}/batch_id={batch_id}", fmt, "overwrite")

    return Sink(name, write, generators)


def console(name: str = "console", pretty: bool = True, rows: int | None = None) -> Sink:
    return Sink(name, lambda batch, batch_id: show(batch, f"{name} {batch_id}", pretty, rows) and None)


def kafka(name: str, topic: str, servers: str, generators: tuple[str, ...] | None = None) -> Sink:
    """Kafka sink: one JSON message per row, at least once (needs the connector jar)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = kafka_payload(batch).write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.option("topic", topic).save()

    return Sink(name, write, generators)


def fan_out(
    stream: DataFrame,
    sinks: Sequence[Sink],
    status_path: str,
    checkpoint: str,
    listeners: Sequence[Callable[[DataFrame, int], None]] = (),
    retry_failed: bool = True,
) -> DataStreamWriter:
    """Write every micro-batch to all sinks and call all listeners.

    The batch is computed once and kept while the targets read it.  A failing target does not
    stop the others; its failure is a row under ``status_path``.  The query then fails after all
    targets were tried, so that a restart repeats the batch for them; ``retry_failed=False`` goes
    on and leaves the batch of a failing target out.
    """
    targets = [(s.name, s) for s in sinks] + [
        (f"listener:{getattr(fn, '__name__', 'call')}", Sink("", fn)) for fn in listeners
    ]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, kept = batch.sparkSession, batch.persist()
        status = []
        try:
            for name, sink in targets:
                rows = kept if sink.generators is None else kept.where(F.col("generator").isin(*sink.generators))
                try:
                    sink.write(rows, batch_id)
                    status.append((batch_id, name, True, None))
                except Exception as error:  # noqa: BLE001 - one bad target must not stop the rest
                    log.error("target %r failed on batch %s: %s", name, batch_id, error)
                    status.append((batch_id, name, False, str(error)))
        finally:
            kept.unpersist()
        rows = spark.createDataFrame(status, STATUS_SCHEMA).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{status_path}/part={batch_id}")
        failed = [name for _, name, ok, _ in status if not ok]
        if failed and retry_failed:
            raise RuntimeError(f"batch {batch_id} failed for {', '.join(failed)}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def status_of(spark, status_path: str) -> DataFrame:
    return spark.read.parquet(status_path).select("batch_id", "sink", "ok", "error")
