"""Native forecasts: coefficient tables and forecasts without Python workers.

A fit is an aggregate per series over all its rows, so its result is a small coefficient table;
a forecast explodes each coefficient row into its horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.operators.series import SeriesKey, lags, newest

HORIZON = 24
PHI_LIMIT = 0.999


def forecast_calendar(last: DataFrame, last_ts: str, steps: int, step_seconds: float) -> DataFrame:
    """One row per future step: ``step`` 1..steps and ``ts`` = last time + step * frequency."""
    exploded = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    micros = F.col("step").cast("long") * F.lit(int(step_seconds * 1_000_000)).cast("long")
    return exploded.withColumn("ts", F.timestamp_add("MICROSECOND", micros, F.col(last_ts)))


def fit_ar(df: DataFrame, key: SeriesKey, value: str) -> DataFrame:
    """ARIMA(1,1,0) by least squares on the differences, one coefficient row per series.

    ``status`` is ``ok``, ``constant`` (no variation to learn from: flat forecast) or ``short``
    (under three points).
    """
    known = df.where(F.col(value).isNotNull())
    rows = lags(known, key, {"_y1": (value, 1), "_y2": (value, 2)})
    rows = rows.withColumn("_dy", F.col(value) - F.col("_y1")).withColumn("_ldy", F.col("_y1") - F.col("_y2"))
    order = F.struct(*key.order)
    cross = F.col("_dy") * F.col("_ldy")
    sums = rows.groupBy(*key.keys).agg(
        F.count("*").alias("n_obs"),
        F.max(key.ts).alias("last_ts"),
        F.max_by(value, order).alias("y_last"),
        F.max_by("_dy", order).alias("dy_last"),
        F.sum(cross).alias("_xy"),
        F.sum(F.col("_ldy") * F.col("_ldy")).alias("_xx"),
        F.sum(F.when(F.col("_ldy").isNotNull(), F.col("_dy") * F.col("_dy"))).alias("_yy"),
        F.count("_ldy").alias("_n"),
    )
    raw = F.coalesce(F.try_divide("_xy", "_xx"), F.lit(0.0))
    phi = F.when(raw > PHI_LIMIT, PHI_LIMIT).when(raw < -PHI_LIMIT, -PHI_LIMIT).otherwise(raw)
    fitted = sums.withColumn("phi", phi)
    rss = F.col("_yy") - 2 * F.col("phi") * F.col("_xy") + F.col("phi") * F.col("phi") * F.col("_xx")
    status = (
        F.when(F.col("n_obs") < 3, "short").when(F.coalesce("_xx", F.lit(0.0)) == 0, "constant").otherwise("ok")
    )
    return fitted.select(
        *key.keys,
        "n_obs",
        "last_ts",
        "y_last",
        F.coalesce("dy_last", F.lit(0.0)).alias("dy_last"),
        "phi",
        F.sqrt(F.greatest(F.coalesce(F.try_divide(rss, F.col("_n")), F.lit(0.0)), F.lit(0.0))).alias("sigma"),
        status.alias("status"),
    )


def forecast_ar(coefficients: DataFrame, steps: int = HORIZON, step_seconds: float = 3600.0) -> DataFrame:
    """Forecast of :func:`fit_ar`: the last difference decays geometrically."""
    future = forecast_calendar(coefficients, "last_ts", steps, step_seconds)
    phi, h = F.col("phi"), F.col("step")
    growth = phi * (F.lit(1.0) - F.pow(phi, h)) / (F.lit(1.0) - phi)
    return future.withColumn("forecast", F.col("y_last") + F.col("dy_last") * growth)


def with_noise(
    forecast: DataFrame, keys: Sequence[str], level: float, seed: int, series_id: str, out: str = "generated"
) -> DataFrame:
    """Forecast plus N(0, level * std) noise.

    The scale is the population standard deviation of the forecast vector of the series; a
    single step has none and uses the in-sample residual deviation ``sigma`` instead.
    """
    w = Window.partitionBy(*keys)
    scale = F.when(F.count("*").over(w) > 1, F.stddev_pop("forecast").over(w)).otherwise(F.col("sigma"))
    z = rng.normal(seed, out, "noise", series_id, "step")
    return forecast.withColumn(out, F.col("forecast") + F.lit(level) * scale * z)


def seasonal_naive(df: DataFrame, key: SeriesKey, value: str, season: int, steps: int, step_seconds: float) -> DataFrame:
    """The last season repeated; only the last ``season`` rows of a series are shuffled on.

    A series shorter than a season goes on flat at its last value, with status ``short``.
    """
    last = newest(df, key, season, rank="_recency")
    w = Window.partitionBy(*key.keys)
    placed = last.withColumns({"_last_ts": F.max(key.ts).over(w), "_size": F.count("*").over(w)})
    whole = F.col("_size") == season
    placed = placed.where(whole | (F.col("_recency") == 1))
    phase = F.when(whole, F.lit(season) - F.col("_recency")).otherwise(F.lit(0))  # 0 for the oldest value of the season
    stride = F.when(whole, F.lit(season)).otherwise(F.lit(1))
    repeated = placed.where(phase < steps).withColumn("step", F.explode(F.sequence(phase + 1, F.lit(steps), stride)))
    micros = F.col("step").cast("long") * F.lit(int(step_seconds * 1_000_000)).cast("long")
    return repeated.select(
        *key.keys,
        "step",
        F.timestamp_add("MICROSECOND", micros, F.col("_last_ts")).alias("ts"),
        F.col(value).alias("forecast"),
        F.when(F.col("_size") == season, "ok").otherwise("short").alias("status"),
    )


def fit_moments(df: DataFrame, key: SeriesKey, value: str | None) -> DataFrame:
    """Mean and sample deviation per series (0 and 1 where there is no value to learn from)."""
    mean = F.avg(value) if value in df.columns else F.lit(None).cast("double")
    std = F.stddev_samp(value) if value in df.columns else F.lit(None).cast("double")
    return df.groupBy(*key.keys).agg(F.max(key.ts).alias("last_ts"), mean.alias("_m"), std.alias("_s")).select(
        *key.keys,
        "last_ts",
        F.coalesce("_m", F.lit(0.0)).alias("mean"),
        F.coalesce("_s", F.when(F.col("_m").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias("std"),
    )


def sample_moments(
    moments: DataFrame, steps: int, step_seconds: float, seed: int, series_id: str, out: str = "generated"
) -> DataFrame:
    """Moment-matched draws on the future grid."""
    future = forecast_calendar(moments, "last_ts", steps, step_seconds)
    z = rng.normal(seed, out, "moments", series_id, "step")
    return future.withColumn(out, F.col("mean") + F.col("std") * z)


# --- feature preparation -----------------------------------------------------


def standardise(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred.

    The moments of the training rows are one-row scalars, literals by the time rows flow.
    """
    source = df if train is None else train
    parts = [x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    fitted = source.agg(F.struct(*parts)).scalar()
    scaled = {}
    for c in columns:
        scale = fitted.getField(f"s_{c}")
        scaled[c] = (F.col(c) - fitted.getField(f"m_{c}")) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return df.withColumns(scaled)


def categories_of(df: DataFrame, column: str) -> DataFrame:
    """Categories of a column as a table (``category``), whatever their number."""
    return df.select(F.col(column).alias("category")).where(F.col(column).isNotNull()).distinct()


def one_hot_rows(df: DataFrame, column: str, categories: DataFrame, row_id: str) -> DataFrame:
    """Sparse form for any number of categories: one row (row id, category) for each one that is set."""
    return df.join(categories, df[column] == categories["category"]).select(row_id, "category")


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column per category; an unknown or missing value gives zeros."""
    value = F.col(column)
    return df.withColumns(
        {f"{column}={c}": F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in categories}
    )
