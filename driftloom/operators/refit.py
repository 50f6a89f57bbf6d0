"""Additive refits: autoregressions from lagged-product sums that are stored and merged.

A batch of a history becomes one row per series: sums of products of lagged differences, and its first
and last few values.  Two such rows merge into the row of both batches, because every window that spans
their border lies in the last values of one and the first values of the other.  So a scheduled refit reads
the new batch and one row per series, never the history, and gives the fit of the whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.forecast import PHI_LIMIT
from driftloom.operators.learned import save_coefficients
from driftloom.operators.series import SeriesKey, lags

FIELDS = ("first_at", "last_at", "n_obs", "last_ts", "head", "tail", "windows", "sums")


def _pairs(p: int) -> list[tuple[int, int]]:
    """Lags (i, j) of the products, in the order of ``sums``: 0 is the newest difference of a window."""
    return [(i, j) for i in range(p + 1) for j in range(i, p + 1)]


def lagged_sums(batch: DataFrame, key: SeriesKey, value: str, p: int = 1) -> DataFrame:
    """One row per series of a batch: ``n_obs``, ``last_ts``, places of the first and last row, the first and
    last ``p + 1`` values, and over all windows of ``p + 2`` values their number and sums of lagged products.

    Missing values (NaN too) are left out.  Rows are ordered by ``key.order``, which should tell them apart;
    a null time comes first.  A null key is a series of its own; an empty batch gives no rows.
    """
    number = F.col(value).cast("double")
    known = batch.where(F.col(value).isNotNull() & ~F.isnan(number)).withColumn("_y0", number)
    rows = lags(known, key, {f"_y{i}": ("_y0", i) for i in range(1, p + 2)})
    place = F.struct(*key.order)
    oldest = F.col(f"_y{p + 1}").isNull()  # among the first p + 1 of its series
    change = [F.col(f"_y{i}") - F.col(f"_y{i + 1}") for i in range(p + 1)]
    whole = F.filter(F.array(*[F.col(f"_y{i}") for i in range(p, -1, -1)]), lambda y: y.isNotNull())
    # A window is whole where its oldest value is there; products of shorter ones would be of other windows.
    change = [F.when(~oldest, c) for c in change]
    sums = [F.coalesce(F.sum(change[i] * change[j]), F.lit(0.0)) for i, j in _pairs(p)]
    head = F.sort_array(F.collect_list(F.when(oldest, F.struct(place.alias("at"), F.col("_y0").alias("y")))))
    return rows.groupBy(*key.keys).agg(
        F.min(place).alias("first_at"),
        F.max(place).alias("last_at"),
        F.count("*").alias("n_obs"),
        F.max(key.ts).alias("last_ts"),
        F.transform(head, lambda h: h["y"]).alias("head"),
        F.max_by(whole, place).alias("tail"),
        F.count_if(~oldest).alias("windows"),
        F.array(*sums).alias("sums"),
    )


def merge_sums(states: DataFrame, keys: Sequence[str], p: int = 1) -> DataFrame:
    """States of :func:`lagged_sums` (or of this) with equal keys merged in order of time.

    One row per batch and series meets in a group; :func:`update_sums` keeps that at two.  Batches of a series
    must follow one another: where one begins before the other ends, the query fails, since windows would differ.
    """
    d = [f"(element_at(joint, _k + {p + 1 - i}) - element_at(joint, _k + {p - i}))" for i in range(p + 1)]
    crossing = ", ".join(f"aggregate(starts, 0.0D, (t, _k) -> t + {d[i]} * {d[j]})" for i, j in _pairs(p))
    border = "concat(a.tail, b.head)"
    spanning = f"size({border}) - {p + 1}"
    starts = f"filter(sequence(1, {p + 1}), _k -> _k <= {spanning})"
    added = f"""transform(array(struct({border} as joint, {starts} as starts)), _w -> {
        f"array({crossing})".replace("joint", "_w.joint").replace("starts", "_w.starts")})[0]"""
    ends = "concat(a.tail, b.tail)"
    merged = f"""struct(
        if(b.first_at <= a.last_at, raise_error('batches of a series overlap in time'), a.first_at) as first_at,
        b.last_at as last_at, a.n_obs + b.n_obs as n_obs, b.last_ts as last_ts,
        slice(concat(a.head, b.head), 1, {p + 1}) as head,
        slice({ends}, greatest(size({ends}) - {p}, 1), {p + 1}) as tail,
        a.windows + b.windows + greatest({spanning}, 0) as windows,
        zip_with(zip_with(a.sums, b.sums, (x, y) -> x + y), {added}, (x, y) -> x + y) as sums)"""
    parts = states.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("_parts"))
    folded = F.expr(f"aggregate(slice(_parts, 2, size(_parts)), _parts[0], (a, b) -> {merged})")
    return parts.select(*keys, folded.alias("_state")).select(*keys, "_state.*")


def update_sums(batch: DataFrame, key: SeriesKey, value: str, path: str, version: int, p: int = 1) -> DataFrame:
    """Merge a batch into the stored sums of ``version - 1`` and store the result as ``version`` (1 begins anew).

    A version depends on the one before and its batch alone, so a repeated run replaces it by the same rows.
    """
    state = lagged_sums(batch, key, value, p)
    if version > 1:
        before = batch.sparkSession.read.parquet(f"{path}/version={version - 1}")
        state = merge_sums(before.unionByName(state), key.keys, p)
    save_coefficients(state, path, version)
    return batch.sparkSession.read.parquet(f"{path}/version={version}")


def fit_sums(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ARIMA(1,1,0) of stored sums (``p = 1``), in the columns of ``forecast.fit_ar``."""
    yy, xy, xx = (F.col("sums")[i] for i in range(3))
    raw = F.coalesce(F.try_divide(xy, xx), F.lit(0.0))
    phi = F.when(raw > PHI_LIMIT, PHI_LIMIT).when(raw < -PHI_LIMIT, -PHI_LIMIT).otherwise(raw)
    fitted = states.withColumn("phi", phi)
    rss = yy - 2 * F.col("phi") * xy + F.col("phi") * F.col("phi") * xx
    last = F.element_at("tail", -1)
    step = F.when(F.size("tail") > 1, last - F.try_element_at("tail", F.lit(-2)))
    status = F.when(F.col("n_obs") < 3, "short").when(xx == 0, "constant").otherwise("ok")
    return fitted.select(
        *keys,
        "n_obs",
        "last_ts",
        last.alias("y_last"),
        F.coalesce(step, F.lit(0.0)).alias("dy_last"),
        "phi",
        F.sqrt(F.greatest(F.coalesce(F.try_divide(rss, F.col("windows")), F.lit(0.0)), F.lit(0.0))).alias("sigma"),
        status.alias("status"),
    )


def fit_orders(states: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """ARIMA(p,1,0) of stored sums: ``phi`` (one coefficient per lag) and ``sigma`` per series.

    Normal equations of one small matrix per row, solved in numpy; a singular one takes the least-squares
    solution of smallest length, and a series without windows gets zeros.
    """
    import numpy as np
    import pandas as pd

    kept = states.select(*keys, "n_obs", "last_ts", "tail", "windows", "sums")

    def solve(frames):
        for frame in frames:
            found, sigma = [], []
            for sums, n in zip(frame["sums"], frame["windows"]):
                full = np.zeros((p + 1, p + 1))
                for (i, j), s in zip(_pairs(p), sums):
                    full[i, j] = full[j, i] = s
                phi = np.linalg.lstsq(full[1:, 1:], full[1:, 0], rcond=None)[0]
                rest = full[0, 0] - 2 * phi @ full[1:, 0] + phi @ full[1:, 1:] @ phi
                found.append(phi.tolist())
                sigma.append(float(np.sqrt(max(rest, 0.0) / n)) if n else 0.0)
            yield frame.drop(columns=["windows", "sums"]).assign(phi=pd.Series(found, index=frame.index), sigma=sigma)

    schema = kept.drop("windows", "sums").schema.add("phi", T.ArrayType(T.DoubleType())).add("sigma", T.DoubleType())
    return kept.mapInPandas(solve, schema)
