"""Batch sinks.  Each one is also usable as a target of the streaming fan-out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import rng

FORMATS = ("csv", "json", "parquet")
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def write_files(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "append", partition_by: Iterable[str] = ()
) -> None:
    """Write a folder of files; ``append`` adds files and never rewrites what is there.

    CSV files carry a header each, JSON is one object per line with null fields kept and times
    as text with a space.  ``partition_by`` (for instance the generator) keeps batches with
    different columns apart.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}, use one of {', '.join(FORMATS)}")
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unsupported mode {mode!r}")
    writer = df.write.mode(mode)
    if tuple(partition_by):
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", TIMESTAMP_TEXT).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).option("timestampNTZFormat", TIMESTAMP_TEXT).json(path)
    else:
        writer.parquet(path)


def message(columns: Iterable[str]) -> Column:
    """One JSON message per row: nulls kept, times as text with a space."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": TIMESTAMP_TEXT}
    return F.to_json(F.struct(*columns), options)


def kafka_payload(df: DataFrame) -> DataFrame:
    """The single ``value`` column the Kafka sink takes (messages have no key)."""
    return df.select(message(df.columns).alias("value"))


def write_kafka(df: DataFrame, topic: str, servers: str) -> None:
    """Batch write to a topic; delivery failures fail the job.  Needs the Kafka connector jar."""
    payload = kafka_payload(df).write.format("kafka").option("kafka.bootstrap.servers", servers)
    payload.option("topic", topic).save()


def show(df: DataFrame, name: str = "console", pretty: bool = True, rows: int | None = None) -> int:
    """Print all rows (or the first ``rows``), a partition at a time; returns how many were printed."""
    picked = df if rows is None else df.limit(rows)
    if pretty:
        print(f"--- {name} ---")
    printed = 0
    for row in (picked if pretty else kafka_payload(picked)).toLocalIterator():
        print(row.asDict() if pretty else row["value"])
        printed += 1
    return printed


def sample(df: DataFrame, fraction: float, seed: int, row_id: str) -> DataFrame:
    """Keyed sample: the same rows for every partitioning and retry."""
    return df.where(rng.uniform(seed, "sample", "row", row_id) < F.lit(fraction))


def export_sample(
    df: DataFrame, path: str, fmt: str = "csv", fraction: float = 1.0, seed: int = 42, row_id: str | None = None
) -> None:
    """Write a sample of the data (all of it by default) as csv, json or parquet."""
    picked = df if row_id is None else sample(df, fraction, seed, row_id)
    write_files(picked, path, fmt, "overwrite")
