"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_SECOND = 1_000_000
_EPOCH = datetime(1970, 1, 1)


def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), ts)


def ntz_of(micros: Column) -> Column:
    """Zone-less timestamp from microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", micros, epoch_ntz())


def micros_value(value: str | date | datetime) -> int:
    """Driver-side microseconds of an ISO string, date or datetime (read as UTC)."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.replace(tzinfo=None) - value.utcoffset()
    delta = value - _EPOCH
    return (delta.days * 86400 + delta.seconds) * MICROS_PER_SECOND + delta.microseconds


def ntz_literal(value: str | date | datetime) -> Column:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Bound a column; null stays null (``greatest``/``least`` would skip it)."""
    branch = None
    if low is not None and low != float("-inf"):
        branch = F.when(value < F.lit(low), F.lit(low))
    if high is not None and high != float("inf"):
        test, bound = value > F.lit(high), F.lit(high)
        branch = F.when(test, bound) if branch is None else branch.when(test, bound)
    return value if branch is None else branch.otherwise(value)


def floor_to(ts: Column, width_us: int, origin_us: int = 0) -> Column:
    """Bucket number of a zone-less timestamp on a fixed grid."""
    return F.floor((micros_of(ts) - F.lit(origin_us)) / F.lit(width_us)).cast("long")


def truncated(ts: Column, seconds: int) -> Column:
    """Start of the bucket of a zone-less timestamp (days start at midnight, weeks on Thursday)."""
    return ntz_of(floor_to(ts, seconds * MICROS_PER_SECOND) * F.lit(seconds * MICROS_PER_SECOND))


def missing_sql(df: DataFrame, name: str) -> str:
    """Null test that also counts NaN as missing for floating columns, as SQL text."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"(`{name}` is null or isnan(`{name}`))"
    return f"(`{name}` is null)"


def present_sql(df: DataFrame, name: str, kind: str | None = None) -> str:
    """The value where it is not missing, optionally cast, as SQL text."""
    value = f"`{name}`" if kind is None else f"cast(`{name}` as {kind})"
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"if(isnan(`{name}`), null, {value})"
    return value


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


#: Steps of a grid that come out of one array.
GRID_BLOCK = 4096


def stepped(df: DataFrame, columns: Sequence[str], start: Column, end: Column, step_seconds: int, out: str) -> DataFrame:
    """``columns`` of every row at every step from ``start`` to ``end`` (both included).

    Steps are dealt in blocks, so the longest array holds a step per block, not per point.
    """
    step = step_seconds * MICROS_PER_SECOND
    last = F.floor((micros_of(F.col("_end")) - micros_of(F.col("_start"))) / F.lit(step)).cast("long")
    rows = df.select(*columns, start.alias("_start"), end.alias("_end")).withColumn("_last", last).where("_last >= 0")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / GRID_BLOCK).cast("long"))))
    first = F.col("_block") * GRID_BLOCK
    rows = rows.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_last"), first + GRID_BLOCK - 1))))
    return rows.select(*columns, F.timestamp_add("MICROSECOND", F.col("_k") * F.lit(step), F.col("_start")).alias(out))
