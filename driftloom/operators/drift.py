"""Controlled drift, its schedule, and the measurement of drift between two batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import rng
from driftloom.functions.scalars import clip, floor_to, ntz_of
from driftloom.operators.generate import choose, cumulative
from driftloom.schema import FieldSpec, TableSpec
from driftloom.session import cut_lineage

#: Batch times of a range that one task walks, about.
PART_TIMES = 1_000_000
# Bounds of a drifted probability before it is normalised.
PROBABILITY_FLOOR, PROBABILITY_CEILING = 0.01, 1.0


def drift(
    df: DataFrame, spec: TableSpec, magnitude: float, row_id: str = "row_id", event: int = 0
) -> DataFrame:
    """Apply one drift event to every row: float means shift, categories are resampled.

    Directions, gates and drifted probabilities belong to the event, not to the rows, so they
    are literals of the plan.  Other field types pass through.
    """
    changed = {}
    for f in spec.fields:
        if f.name not in df.columns:
            continue
        if f.kind == "float":
            sign = drift_direction(spec.seed, f.name, event)
            changed[f.name] = _shifted(f, F.lit(sign * magnitude * f.std))
        elif f.kind == "category" and gate_open(spec.seed, f.name, magnitude, event):
            edges = cumulative(drifted_probabilities(f, spec.seed, magnitude, event))
            changed[f.name] = _resampled(f, spec.seed, magnitude, row_id, event, edges)
    return df.withColumns(changed)


def drift_direction(seed: int, field: str, event: int) -> float:
    return -1.0 if rng.uniform_value(seed, field, "drift/direction", event) < 0.5 else 1.0


def gate_open(seed: int, field: str, magnitude: float, event: int) -> bool:
    return rng.uniform_value(seed, field, "drift/gate", event) < magnitude


def drifted_probabilities(f: FieldSpec, seed: int, magnitude: float, event: int) -> list[float]:
    moved = []
    for k, p in enumerate(f.probabilities):
        p = p + magnitude * rng.normal_value(seed, f.name, f"drift/p{k}", event)
        moved.append(min(max(p, PROBABILITY_FLOOR), PROBABILITY_CEILING))
    total = sum(moved)
    return [p / total for p in moved]


def _shifted(f: FieldSpec, amount: Column) -> Column:
    return clip(F.col(f.name) + amount, f.low, f.high)


def _resampled(f: FieldSpec, seed: int, magnitude: float, row_id: str, event: str | int, edges) -> Column:
    hit = rng.uniform(seed, f.name, "drift/mask", row_id, event) < F.lit(magnitude)
    u = rng.uniform(seed, f.name, "drift/pick", row_id, event)
    return F.when(hit, choose(f.categories, edges, u)).otherwise(F.col(f.name))


# --- schedule ----------------------------------------------------------------


def drift_epochs(df: DataFrame, ts: str, batch: str, origin_us: Column, interval_seconds: float, part_times: int = PART_TIMES) -> DataFrame:
    """The batches that drift: a batch drifts once ``interval_seconds`` have passed since the last drift.

    ``origin_us`` is the start of the run.  One row per drift event, with ``epoch`` (the number of
    whole intervals since the start), the ``batch`` that drifts and ``drift_ts``, the time it
    starts.  Batch times are dealt into ranges of about ``part_times``.  A range maps the last drift
    before it to the last drift in it, which is a step function with at most as many steps as
    one interval holds batches.  The functions of all ranges follow one another, a few steps
    each, and give every range the drift it starts from; then all ranges are walked at once.
    """
    width = int(interval_seconds * 1_000_000)
    starts = df.groupBy(batch).agg(F.min(ts).alias("drift_ts")).withColumn("_t", floor_to(F.col("drift_ts"), 1) - origin_us)
    # of batches that start together the first one stands for all
    times = cut_lineage(starts.where("_t >= 0").groupBy("_t").agg(F.min(batch).alias(batch), F.min("drift_ts").alias("drift_ts")))
    n = -(-times.count() // max(1, part_times))
    if n > 1:
        parts = cut_lineage(times.repartitionByRange(n, "_t").withColumn("_part", F.spark_partition_id()))
        parts = parts.join(_entries(parts, width), "_part")
    else:
        parts = times.withColumns({"_part": F.lit(0), "_from": F.lit(0).cast("long")})
    schema = T.StructType([times.schema[c] for c in ("_t", batch, "drift_ts")])

    def walk(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_t").to_numpy(), kind="stable")
        t, last, hits = table.column("_t").to_numpy()[order], table.column("_from")[0].as_py(), []
        while (at := int(np.searchsorted(t, last + width))) < len(t):
            hits.append(order[at])
            last = int(t[at])
        return table.select(["_t", batch, "drift_ts"]).take(pa.array(hits, pa.int64()))

    events = parts.groupBy("_part").applyInArrow(walk, schema)
    return events.select(F.floor(F.col("_t") / F.lit(width)).cast("long").alias("epoch"), batch, "drift_ts")


def _steps(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of sorted times: ``(up to, last)``, the last drift for an entering one of at most ``up to``.

    An entering drift lies before the first time, so a walk starts within one interval of it, or just behind.
    """
    following = np.searchsorted(t, t + width)
    ends = np.where(following < len(t), following, np.arange(len(t)))
    while (further := ends[ends]).tobytes() != ends.tobytes():
        ends = further
    first = min(len(t), int(np.searchsorted(t, t[0] + width)) + 1)
    last = t[ends[:first]]
    kept = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
    return t[:first][kept] - width, last[kept]


def _entries(parts: DataFrame, width: int) -> DataFrame:
    """``_part`` and ``_from``: the last drift before every range of times, zero at the start."""

    def steps(table: pa.Table) -> pa.Table:
        upto, last = _steps(np.sort(table.column("_t").to_numpy()), width)
        return pa.table({"_part": table.column("_part").slice(0, 1), "upto": pa.array([upto.tolist()]), "last": pa.array([last.tolist()])})

    def follow(table: pa.Table) -> pa.Table:
        order, entered, last = np.argsort(table.column("_part").to_numpy()), {}, 0
        for i in order.tolist():
            entered[i] = last
            upto = table.column("upto")[i].values.to_numpy()
            at = int(np.searchsorted(upto, last))
            last = table.column("last")[i].values[at].as_py() if at < len(upto) else last
        return pa.table({"_part": table.column("_part"), "_from": pa.array([entered[i] for i in range(len(order))], pa.int64())})

    functions = parts.select("_part", "_t").groupBy("_part").applyInArrow(steps, "_part int, upto array<long>, last array<long>")
    # one row per range, not per time
    return cut_lineage(functions.groupBy(F.lit(0).alias("_all")).applyInArrow(lambda t: follow(t), "_part int, _from long"))


def event_parameters(epochs: DataFrame, spec: TableSpec, magnitude: float) -> DataFrame:
    """Per drift event: the shift of every float field and the edges of every open category."""
    epoch, first, second = "epoch", {}, {}
    for f in spec.fields:
        if f.kind == "float":
            down = rng.uniform(spec.seed, f.name, "drift/direction", epoch) < 0.5
            step = magnitude * f.std
            first[f"_shift_{f.name}"] = F.when(down, F.lit(-step)).otherwise(F.lit(step))
        elif f.kind == "category":
            moved = [
                clip(
                    F.lit(p) + F.lit(magnitude) * rng.normal(spec.seed, f.name, f"drift/p{k}", epoch),
                    PROBABILITY_FLOOR,
                    PROBABILITY_CEILING,
                )
                for k, p in enumerate(f.probabilities)
            ]
            first[f"_moved_{f.name}"] = F.array(*moved)
            parts = [F.col(f"_moved_{f.name}")[k] for k in range(len(moved))]
            total = sum(parts[1:], parts[0])
            edges = [sum(parts[1 : k + 1], parts[0]) / total for k in range(len(parts) - 1)]
            is_open = rng.uniform(spec.seed, f.name, "drift/gate", epoch) < F.lit(magnitude)
            second[f"_edges_{f.name}"] = F.when(is_open, F.array(*edges))
    moved_columns = [name for name in first if name.startswith("_moved_")]
    return epochs.withColumns(first).withColumns(second).drop(*moved_columns)


def drift_on_schedule(
    df: DataFrame,
    spec: TableSpec,
    magnitude: float,
    ts: str,
    batch: str,
    origin_us: Column,
    interval_seconds: float,
    row_id: str = "row_id",
) -> DataFrame:
    """Drift only the rows of batches that fall on the schedule; adds ``drifted`` and ``epoch``.

    The event table has one row per drift interval.  It is joined without a hint: Spark
    broadcasts it when its measured size allows and otherwise shuffles, splitting a hot batch.
    """
    events = event_parameters(
        drift_epochs(df, ts, batch, origin_us, interval_seconds), spec, magnitude
    ).drop("drift_ts")
    joined = df.join(events, batch, "left")
    on = F.col("epoch").isNotNull()
    changed = {}
    for f in spec.fields:
        if f.name not in df.columns:
            continue
        if f.kind == "float":
            changed[f.name] = F.when(on, _shifted(f, F.col(f"_shift_{f.name}"))).otherwise(F.col(f.name))
        elif f.kind == "category":
            edges_column = F.col(f"_edges_{f.name}")
            edges = [edges_column[k] for k in range(len(f.categories) - 1)]
            drawn = _resampled(f, spec.seed, magnitude, row_id, "epoch", edges)
            changed[f.name] = F.when(edges_column.isNotNull(), drawn).otherwise(F.col(f.name))
    return joined.withColumns({**changed, "drifted": on}).select(*df.columns, "drifted", "epoch")


def drift_counts(df: DataFrame, generator: str, batch: str, drifted: str, ts: str) -> DataFrame:
    """Per generator: batches, batches that drifted, and the last time one did."""
    return (
        df.groupBy(generator, batch)
        .agg(F.max(drifted).alias("_drifted"), F.min(ts).alias("_ts"))
        .groupBy(generator)
        .agg(
            F.count("*").alias("batches"),
            F.count_if("_drifted").alias("drift_events"),
            F.max(F.when(F.col("_drifted"), F.col("_ts"))).alias("last_drift"),
        )
    )


# --- measurement -------------------------------------------------------------


def mean_shift(baseline: DataFrame, drifted: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: means of both sides and the shift in baseline standard deviations.

    One pass over each side; the two one-row results meet on the column name.
    """

    def moments(df: DataFrame, suffix: str) -> DataFrame:
        stats = [
            F.struct(
                F.lit(c).alias("column"),
                F.avg(c).alias(f"mean_{suffix}"),
                F.stddev_samp(c).alias(f"std_{suffix}"),
            )
            for c in columns
        ]
        return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))

    before, after = moments(baseline, "before"), moments(drifted, "after")
    shift = F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("std_before"))
    return before.join(after, "column").select(
        "column", "mean_before", "mean_after", "std_before", shift.alias("shift_in_std")
    )


def share_change(baseline: DataFrame, drifted: DataFrame, column: str) -> DataFrame:
    """Per category: its share on both sides and the change, absent categories counting as 0."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count("*").alias("_n"))
        total = df.agg(F.count("*")).scalar()
        return counts.select(F.col(column).alias("category"), (F.col("_n") / total).alias(name))

    before, after = shares(baseline, "share_before"), shares(drifted, "share_after")
    joined = before.join(after, before["category"].eqNullSafe(after["category"]), "full_outer")
    b, a = F.coalesce("share_before", F.lit(0.0)), F.coalesce("share_after", F.lit(0.0))
    return joined.select(
        F.lit(column).alias("column"),
        F.coalesce(before["category"], after["category"]).alias("category"),
        b.alias("share_before"),
        a.alias("share_after"),
        (a - b).alias("share_change"),
    )
