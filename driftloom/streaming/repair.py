"""Repair of a running stream from fitted models and the context that earlier micro-batches left.

The state is one row per series: its last known value, the last difference and how many rows have
passed since.  A micro-batch is repaired by the batch operator, which cuts long series into chunks,
so a hot series is spread over tasks.  State tables rotate over three folders: a batch reads that of
the one before it and writes its own, so a replay repeats exactly and the space does not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from driftloom.operators.fallback import CONTEXT, fill_from_model
from driftloom.operators.series import SeriesKey

FOLDERS = 3


def _state_path(path: str, batch_id: int) -> str:
    return f"{path}/state/{batch_id % FOLDERS}"


def repair(
    stream: DataFrame, key: SeriesKey, value: str, model: DataFrame, emitted_at: Column, path: str, checkpoint: str, reason: str | None = None
) -> DataStreamWriter:
    """Repair every micro-batch into a folder of its own under ``path``; read it with :func:`repaired`.

    ``model`` is a stored table of :func:`forecast.fit_ar`.  Rows of a series count in the order of
    their micro-batches, and by time within one; what comes late counts where it arrives.
    """
    keys = list(key.keys)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, out = batch.sparkSession, f"{path}/rows/batch_id={batch_id}"
        known = spark.read.parquet(_state_path(path, batch_id - 1)) if batch_id else None
        filled = fill_from_model(batch, key, value, model, emitted_at, reason, context=known, keep_context=True)
        filled.write.mode("overwrite").parquet(out)
        now = spark.read.schema(filled.schema).parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*CONTEXT), "_at").alias("_state"), F.lit(batch_id).alias("_batch"))
        if known is not None:
            now = now.unionByName(known.select(*keys, F.struct(*CONTEXT).alias("_state"), F.lit(batch_id - 1).alias("_batch")))
        merged = now.groupBy(*keys).agg(F.max_by("_state", "_batch").alias("_state"))
        merged.select(*keys, "_state.*").write.mode("overwrite").parquet(_state_path(path, batch_id))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def repaired(spark: SparkSession, path: str) -> DataFrame:
    """All repaired rows."""
    return spark.read.parquet(f"{path}/rows").drop("batch_id", "_at", *CONTEXT)
