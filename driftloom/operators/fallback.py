"""Real-or-synthetic repair of series on a time grid, with provenance per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import stepped
from driftloom.operators.series import SeriesKey, carry_forward, chunked, lag, matched, position

RATIO_LIMIT, RATIO_MINIMUM = 0.8, 10


def time_grid(
    series: DataFrame, keys: Sequence[str], start: Column, end: Column, step_seconds: int, out: str = "bucket"
) -> DataFrame:
    """Every series at every step from ``start`` to ``end``; one input row per series."""
    return stepped(series, keys, start, end, step_seconds, out)


def fill(
    grid: DataFrame,
    real: DataFrame,
    keys: Sequence[str],
    bucket: str,
    value: str,
    synthetic: Column,
    reason: str | None = None,
    carry: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Real value where there is one, else the last good one (optional), else the synthetic one.

    ``real`` has at most one row per (series, bucket), so the join cannot be skewed by a hot
    series.  Its ``reason`` column tells why a present bucket has no value (rate_limited,
    error); a bucket without a row is ``missing``.  ``synthetic`` is an expression over the grid
    columns.  Adds ``data_type`` (real, synthetic or empty) and ``reason``, never overwritten.
    """
    names = [*keys, bucket]
    wanted = real.select(*names, value, *([reason] if reason else []))
    joined = matched(grid, wanted, names)
    cause = F.coalesce(F.col(reason), F.lit("missing")) if reason else F.lit("missing")
    has = F.col(value).isNotNull()
    made = F.when(synthetic.isNotNull(), F.lit("synthetic")).otherwise(F.lit("empty"))
    tagged = joined.withColumns(
        {
            "_value": F.col(value),
            "data_type": F.when(has, F.lit("real")).otherwise(made),
            "_reason": F.when(~has, cause),
        }
    )
    if carry:
        key = SeriesKey(tuple(keys), bucket)
        tagged = carry_forward(tagged, key, value, "_carried")
        has_carried = F.col("_carried").isNotNull() & (F.col("data_type") == "empty")
        tagged = tagged.withColumn("data_type", F.when(has_carried, "synthetic").otherwise(F.col("data_type")))
        filled = F.coalesce("_value", "_carried", synthetic)
    else:
        filled = F.coalesce(F.col("_value"), synthetic)
    return tagged.withColumn("_filled", filled).select(
        *names, *keep, F.col("_filled").alias(value), "data_type", F.col("_reason").alias("reason")
    )


#: What a series hands on: its last known value, the last difference, and the rows since.
CONTEXT = ("_y", "_dy", "_since")


def fill_from_model(
    rows: DataFrame, key: SeriesKey, value: str, coefficients: DataFrame, emitted_at: Column, reason: str | None = None,
    context: DataFrame | None = None, keep_context: bool = False,
) -> DataFrame:
    """Missing values of a gridded series from its fitted model (:func:`forecast.fit_ar`) and recent context.

    A gap of h steps after the last known value takes the model's forecast h steps ahead of it.  Adds
    ``data_type``, ``source`` (real, model or none), ``error`` (why the value is missing) and ``emitted_at``.
    ``context`` (``_y``, ``_dy``, ``_since`` per series) is what came before the first row of a series;
    ``keep_context`` adds these three and the position ``_at`` for every row.
    """
    known = F.col(value).isNotNull()
    placed = position(chunked(rows, key), key, "_at")
    if context is None:
        nothing = {"_y0": "double", "_dy0": "double", "_since0": "bigint"}
        placed = placed.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    else:
        placed = matched(placed, context.select(*key.keys, *[F.col(c).alias(f"{c}0") for c in ("_y", "_dy", "_since")]), key.keys)
    seen = F.when(known, F.col(value))
    # the value known before each row, looked up on the rows themselves, so a repeated time stays one row
    upto = carry_forward(placed.withColumn("_seen", seen), key, "_seen", "_upto")
    before = lag(upto, key, "_upto", 1, "_before")
    dy = F.coalesce(F.col(value) - F.coalesce("_before", "_y0"), F.lit(0.0))
    found = F.when(known, F.struct(F.col(value).cast("double").alias("y"), dy.alias("dy"), F.col("_at").alias("at")))
    carried = carry_forward(before.withColumn("_found", found), key, "_found", "_last")
    joined = matched(carried, coefficients.select(*key.keys, "phi"), key.keys).withColumns({
        "_y": F.coalesce("_last.y", "_y0"), "_dy": F.coalesce("_last.dy", "_dy0"),
        "_since": F.col("_at") - F.coalesce("_last.at", -F.col("_since0")),
    })
    phi = F.col("phi")
    made = F.col("_y") + F.col("_dy") * phi * (F.lit(1.0) - F.pow(phi, F.col("_since"))) / (F.lit(1.0) - phi)
    source = F.when(known, "real").when(made.isNotNull(), "model").otherwise("none")
    error = F.when(~known, F.coalesce(F.col(reason), F.lit("missing")) if reason else F.lit("missing"))
    filled = joined.withColumns({
        "_filled": F.coalesce(F.col(value), made),
        "data_type": F.when(known, "real").when(made.isNotNull(), "synthetic").otherwise("empty"),
        "source": source, "error": error, "emitted_at": emitted_at,
    })
    values = [F.col("_filled").alias(c) if c == value else F.col(c) for c in rows.columns]
    extra = ("_at", "_y", "_dy", "_since") if keep_context else ()
    return filled.select(*values, "data_type", "source", "error", "emitted_at", *extra)


def fill_stream(
    stream: DataFrame, moments: DataFrame, keys: Sequence[str], value: str, seed: int, row_id: str, emitted_at: Column
) -> DataFrame:
    """Missing values of a stream from a stored model table (``mean``, ``std``) by a stream-static join.

    Adds ``source`` (real, model or none), ``error`` (the reason column of the row) and ``emitted_at``.
    A row whose key the model does not know stays, without a value.
    """
    joined = matched(stream, moments.select(*keys, "mean", "std"), keys)
    made = F.col("mean") + F.col("std") * rng.normal(seed, value, "fallback", row_id)
    real = F.col(value).isNotNull()
    return joined.withColumns({
        "source": F.when(real, "real").when(made.isNotNull(), "model").otherwise("none"),
        "error": F.when(~real, F.coalesce("reason", F.lit("missing"))),
        "emitted_at": emitted_at, "_filled": F.coalesce(F.col(value), made),
    }).drop("mean", "std", value).withColumnRenamed("_filled", value)


def synthetic_ratio(
    df: DataFrame, keys: Sequence[str], bucket: str, limit: float = RATIO_LIMIT, minimum: int = RATIO_MINIMUM
) -> DataFrame:
    """Per series: row and batch counts by type, the share of synthetic batches and the warning.

    A batch is one bucket of a series and counts as synthetic when it holds no real row.
    """
    batches = df.groupBy(*keys, bucket).agg(
        F.count_if(F.col("data_type") == "real").alias("_real"),
        F.count_if(F.col("data_type") == "synthetic").alias("_synthetic"),
    )
    totals = batches.groupBy(*keys).agg(
        F.sum("_real").alias("real_rows"),
        F.sum("_synthetic").alias("synthetic_rows"),
        F.count_if(F.col("_real") > 0).alias("real_batches"),
        F.count_if((F.col("_real") == 0) & (F.col("_synthetic") > 0)).alias("synthetic_batches"),
    )
    total = F.col("real_batches") + F.col("synthetic_batches")
    ratio = F.coalesce(F.try_divide("synthetic_batches", total), F.lit(0.0))
    return totals.withColumns({"synthetic_ratio": ratio, "warning": (total > minimum) & (ratio > limit)})


def monitor(df: DataFrame, name: Column, ts: str, batch: Column) -> DataFrame:
    """Per streamer: rows by type, error batches, last time, and batches per type.

    Two aggregates, both combined on the map side.
    """
    batches = df.groupBy(name.alias("streamer"), batch.alias("_batch"), "data_type").agg(
        F.count("*").alias("_n"),
        F.max(ts).alias("_last"),
        F.max(F.coalesce(F.col("reason") == "error", F.lit(False))).alias("_error"),
    )

    def rows(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("data_type") == kind, F.col("_n"))), F.lit(0))

    def count(kind: str) -> Column:
        return F.count_if(F.col("data_type") == kind).alias(f"{kind}_batches")

    return batches.groupBy("streamer").agg(
        F.sum("_n").alias("data_points"),
        rows("real").alias("real_data"),
        rows("synthetic").alias("synthetic_data"),
        F.count_if("_error").alias("errors"),
        F.max("_last").alias("last_data_time"),
        count("real"),
        count("synthetic"),
        count("empty"),
    )


def run_statistics(df: DataFrame, generator: Column, batch: Column, drifted: Column, ts: str) -> DataFrame:
    """Per generator: batches, records, drift events, run time and records per second."""
    batches = df.groupBy(generator.alias("generator"), batch.alias("_batch")).agg(
        F.count("*").alias("_n"), F.max(drifted).alias("_d"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    runtime = F.timestamp_diff("MICROSECOND", F.min("_first"), F.max("_last")) / F.lit(1_000_000.0)
    stats = batches.groupBy("generator").agg(
        F.count("*").alias("batches_generated"),
        F.sum("_n").alias("records_generated"),
        F.count_if("_d").alias("drift_events"),
        runtime.alias("runtime_seconds"),
    )
    rate = F.try_divide("records_generated", "runtime_seconds")
    return stats.withColumn("records_per_second", rate)
