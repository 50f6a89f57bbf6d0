"""Normalising landed raw JSON payloads into rows.

Every function takes a frame with a JSON text column and is a narrow transformation: parse,
explode, cast.  There is no shuffle; a big payload is one row and its points become rows in
the same task.  The exploding is always the outer form with a filter on its output: for the
inner form the optimizer adds a filter on its input, which would parse the payload once more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut_lineage

BAR_FIELDS = ("open", "high", "low", "close", "volume")
# Fixed texts that mark the payload shapes.
SERIES_MARK = "Time Series"
RATE_NOTE = "API call frequency"


def _fields(value: Column, of: str = "variant") -> Column:
    """Fields of a JSON object by name, or null where ``value`` is no object."""
    return F.try_variant_get(value, "$", f"map<string,{of}>")


def _series(top: Column) -> Column:
    """Value under the first key (in the order of names) that contains the series mark; null where there is none."""
    key = F.try_element_at(F.array_sort(F.filter(F.map_keys(top), lambda k: k.contains(SERIES_MARK))), F.lit(1))
    return F.try_element_at(top, key)


def _there(value: Column) -> Column:
    """Whether a variant is there and is not a JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def map_payload(
    df: DataFrame, payload: str, keep: Sequence[str] = (), fields: Sequence[str] = BAR_FIELDS
) -> DataFrame:
    """Map of maps: the keys of the series are times, the inner maps hold numbered fields.

    The text is parsed once, into a variant.  Values that are not numbers become null, a point that is
    no object has only nulls, and an object that names a field twice counts as malformed.
    """
    top = df.select(*keep, _fields(F.try_parse_json(payload)).alias("_top"))
    points = top.select(*keep, F.explode_outer(_fields(_series(F.col("_top")))).alias("_at", "_point"))
    points = points.where("_at is not null").select(*keep, "_at", _fields(F.col("_point"), "string").alias("_point"))
    # a name may carry a number, as in "1. open"
    names = F.transform(F.map_keys("_point"), lambda k: F.substring_index(k, ". ", -1))
    points = points.select(*keep, "_at", names.alias("_names"), F.map_values("_point").alias("_values"))
    at = [F.nullif(F.array_position("_names", f), F.lit(0)).cast("int") for f in fields]
    numbers = [F.try_element_at("_values", i).try_cast("double").alias(f) for f, i in zip(fields, at)]
    return points.select(*keep, F.col("_at").try_cast("timestamp_ntz").alias("ts"), *numbers)


def array_payload(
    df: DataFrame, payload: str, keep: Sequence[str] = (), fields: Sequence[str] = BAR_FIELDS
) -> DataFrame:
    """Parallel arrays of the first result; times are epoch seconds, an empty result has no rows."""
    quote = ", ".join(f"{f}: array<double>" for f in fields)
    shape = (
        "struct<chart: struct<result: array<struct<timestamp: array<bigint>, "
        f"indicators: struct<quote: array<struct<{quote}>>>>>>>"
    )
    parsed = df.select(*keep, F.from_json(F.col(payload), shape).alias("_p"))
    result = F.try_element_at(F.col("_p.chart.result"), F.lit(1))
    arrays = parsed.select(
        *keep,
        result["timestamp"].alias("_times"),
        F.try_element_at(result["indicators"]["quote"], F.lit(1)).alias("_quote"),
    ).select(*keep, "_times", *[F.col("_quote")[f].alias(f) for f in fields])
    points = arrays.select(*keep, F.inline_outer(F.arrays_zip("_times", *fields)))
    points = points.where(reduce(or_, [F.col(c).isNotNull() for c in ("_times", *fields)]))
    return points.select(*keep, _from_seconds("_times"), *fields)


def record_payload(
    df: DataFrame, payload: str, keep: Sequence[str] = (), fields: Sequence[str] = BAR_FIELDS
) -> DataFrame:
    """Array of records under ``Data`` with an epoch-seconds ``time``."""
    record = ", ".join(["time: bigint", *[f"{f}: double" for f in fields]])
    parsed = df.select(*keep, F.from_json(F.col(payload), f"struct<Data: array<struct<{record}>>>").alias("_p"))
    points = parsed.select(*keep, F.inline_outer("_p.Data"))
    points = points.where(reduce(or_, [F.col(c).isNotNull() for c in ("time", *fields)]))
    return points.select(*keep, _from_seconds("time"), *fields)


def _from_seconds(name: str) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.col(name), epoch).alias("ts")


def classified(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``shape`` (map, arrays, records or null) and ``reason`` (null for a good payload).

    Everything is read from one variant per payload.
    """
    top, whole = F.col("_top"), F.col("_whole")
    series = _there(_series(top))
    has_arrays = _there(F.try_variant_get(whole, "$.chart.result[0]", "variant"))
    has_records = _there(F.try_variant_get(whole, "$.Data[0]", "variant"))

    def said(field: str) -> Column:
        return F.try_variant_get(whole, f"$['{field}']", "string")

    limited = F.coalesce(said("Note").contains(RATE_NOTE), F.lit(False))
    failed = said("Error Message").isNotNull() | F.coalesce(said("Response") == F.lit("Error"), F.lit(False))
    found = F.when(series, "map").when(has_arrays, "arrays").when(has_records, "records")
    reason = (
        F.when(top.isNull(), F.lit("malformed"))
        .when(failed, F.lit("error"))
        .when(F.col("shape").isNotNull(), F.lit(None).cast("string"))
        .when(limited, F.lit("rate_limited"))
        .otherwise(F.lit("empty"))
    )
    parsed = df.withColumn("_whole", F.try_parse_json(payload)).withColumn("_top", _fields(whole))
    tagged = parsed.withColumn("shape", found).withColumn("reason", reason)
    return tagged.withColumn("shape", F.when(F.col("reason").isNull(), F.col("shape"))).drop("_top", "_whole")


def split(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(good payloads with their shape, quarantined payloads with the reason), classified once and written."""
    tagged = cut_lineage(classified(df, payload))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null").drop("shape")
