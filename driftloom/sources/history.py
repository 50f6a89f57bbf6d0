"""History tables: range scans, granularity by span, and default synthetic series."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import MICROS_PER_SECOND, floor_to, micros_of, ntz_literal, ntz_of, stepped
from driftloom.operators.series import SeriesKey, ohlcv

MINUTE, HOUR, DAY, WEEK = 60, 3600, 86400, 604800
# Per kind of source, (longest span in days, bar width in seconds); None is "longer".
GRANULARITY: dict[str, tuple[tuple[int | None, int], ...]] = {
    "map": ((5, 5 * MINUTE), (100, DAY), (None, WEEK)),
    "arrays": ((5, 5 * MINUTE), (30, 30 * MINUTE), (90, HOUR), (365, DAY), (None, WEEK)),
    "records": ((3, MINUTE), (30, HOUR), (None, DAY)),
}


def read_history(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Parquet history; ``merge_schema`` for files appended with different columns."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def between(df: DataFrame, ts: str, start: Any, end: Any | None = None) -> DataFrame:
    """Rows with ``start <= ts <= end`` (both included); the bounds reach the Parquet scan."""
    kept = df.where(F.col(ts) >= ntz_literal(start))
    return kept if end is None else kept.where(F.col(ts) <= ntz_literal(end))


def last_days(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` before the newest row (warm start)."""
    newest_ts = df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest_ts - F.make_dt_interval(F.lit(days)))


def bar_seconds(kind: str, days: Column) -> Column:
    """Bar width a source of this kind uses for a span in days."""
    width = None
    for longest, seconds in GRANULARITY[kind]:
        if longest is None:
            return _long(seconds) if width is None else width.otherwise(_long(seconds))
        test = days <= F.lit(longest)
        width = F.when(test, _long(seconds)) if width is None else width.when(test, _long(seconds))
    return width


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def bars_by_span(
    df: DataFrame, key: SeriesKey, value: str, volume: Column, kind: str, aggregate: int = 1
) -> DataFrame:
    """Bars whose width follows from the span of the table: one scalar and one combined aggregate."""
    span = df.agg(F.floor((micros_of(F.max(key.ts)) - micros_of(F.min(key.ts))) / (DAY * MICROS_PER_SECOND)))
    width = bar_seconds(kind, span.scalar()) * F.lit(aggregate)
    width_us = width * F.lit(MICROS_PER_SECOND)
    bucket = ntz_of(F.floor(micros_of(F.col(key.ts)) / width_us).cast("long") * width_us)
    return ohlcv(df, key, value, volume, bucket).withColumn("bar_seconds", width.cast("long"))


def default_series(
    bounds: DataFrame, keys: Sequence[str], start: str, end: str, seed: int, series_id: str
) -> DataFrame:
    """Daily standard-normal series from ``start`` to ``end`` (both included), one per row of bounds.

    The value is keyed by series and day, so any slice of the grid can be made alone.
    """
    day = DAY * MICROS_PER_SECOND
    numbered_rows = bounds.withColumn("_id", F.expr(series_id))
    grid = stepped(numbered_rows, [*keys, "_id"], F.col(start), F.col(end), DAY, "timestamp")
    numbered = grid.withColumn("_day", floor_to(F.col("timestamp"), day))
    value = rng.normal(seed, "value", "default", "_id", "_day")
    return numbered.select(*keys, "timestamp", value.alias("value"))


def default_point(series: DataFrame, keys: Sequence[str], at: str, seed: int, series_id: str) -> DataFrame:
    """Default data without a range: one standard-normal point per series at the time ``at``."""
    placed = series.withColumns({"_id": F.expr(series_id), "_day": floor_to(F.col(at), DAY * MICROS_PER_SECOND)})
    return placed.select(*keys, F.col(at).alias("timestamp"), rng.normal(seed, "value", "default", "_id", "_day").alias("value"))
