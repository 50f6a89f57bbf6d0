"""Streaming sources: landed files and continuous row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landed_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str | None = None,
    files_per_batch: int = 1000,
    fmt: str = "parquet",
) -> DataFrame:
    """Files as they land in a folder; ``files_per_batch`` admits work at a steady rate."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def continuous_rows(spark: SparkSession, rows_per_batch: int, partitions: int | None = None) -> DataFrame:
    """Endless row ids: micro-batch k holds ``k * rows_per_batch`` onwards.

    The ids feed the generator expressions, so a replayed micro-batch has the same rows.
    """
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    return reader.load().select(F.col("value").alias("row_id"))
