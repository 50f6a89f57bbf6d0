"""Order-dependent operations on series, safe for a series that holds most of the rows.

A plain window over a series puts the whole series into one task.  The operators here cut
large tables into chunks of bounded size and work in three steps:

1. rows are range-partitioned by (series, time, tie) over sampled edges and written with the
   number of their chunk, whatever the spread of the times (:func:`chunked`);
2. a summary with one row per chunk, over which a window per series carries context from
   chunk to chunk (its size is the number of chunks, not of rows);
3. windows over ``(series, chunk)`` and an equi-join of that context.

Results do not depend on the chunks; these only set the size of the groups.  Operators that
follow one another share chunks: rows that :func:`chunked` returned are not cut again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import floor_to, micros_of
from driftloom.session import cut_lineage

CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class SeriesKey:
    """How rows form series: key columns, time column, and tie breakers within one time.

    A table of more than ``chunk_rows`` rows is cut into chunks of about that many rows;
    ``chunk_seconds`` cuts by a fixed span of time instead, which is for series known to be even.
    """

    keys: tuple[str, ...]
    ts: str
    tie: tuple[str, ...] = ()
    chunk_rows: int = CHUNK_ROWS
    chunk_seconds: float | None = None

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    def within(self, backwards: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if backwards else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*order)

    def across(self, backwards: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col("_chunk").desc() if backwards else F.col("_chunk"))


# Looking ahead is looking back in the reverse order: Spark evaluates a frame that grows from the
# start in one pass, but one that ends at the last row in quadratic time.
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def chunked(df: DataFrame, key: SeriesKey) -> DataFrame:
    """Rows with their ``_chunk`` number, increasing with time within a series.

    Edges are sampled over (series, time, tie), so a stray date, a burst or a null key makes no
    large chunk; rows equal in all of these are told apart by a hash of the row.  The table is
    written once, as sampling again would move the edges.
    """
    if "_chunk" in df.columns:
        return df
    if key.chunk_seconds is not None:
        chunk = F.floor(micros_of(F.col(key.ts)) / F.lit(int(key.chunk_seconds * 1_000_000))).cast("long")
        return df.withColumn("_chunk", F.coalesce(chunk, F.lit(-(1 << 62))))  # null times come first
    n = -(-df.count() // key.chunk_rows)
    if n <= 1:
        return df.withColumn("_chunk", F.lit(0).cast("long"))
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    dealt = df.repartitionByRange(n, *key.keys, *key.order, F.xxhash64(*plain))
    return cut_lineage(dealt.withColumn("_chunk", F.spark_partition_id().cast("long")))


def _joined(rows: DataFrame, context: DataFrame, key: SeriesKey) -> DataFrame:
    """Rows with the context of their chunk; a null key matches itself."""
    return matched(rows, context, [*key.keys, "_chunk"])


def matched(rows: DataFrame, context: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join of rows with the columns ``context`` has for their ``names``; a null name matches itself."""
    renamed = context.select(*[F.col(c).alias(f"_c_{c}") for c in names], *[c for c in context.columns if c not in names])
    match = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in names]
    return rows.join(renamed, reduce(and_, match), "left").drop(*[f"_c_{c}" for c in names])


def carry_forward(df: DataFrame, key: SeriesKey, column: str, out: str | None = None) -> DataFrame:
    """Last known value at or before each row of the series (null before the first one)."""
    out = out or f"{column}_filled"
    rows = chunked(df, key)
    newest = F.when(F.col(column).isNotNull(), F.struct(*key.order, F.col(column).alias("_v")))
    chunks = rows.groupBy(*key.keys, "_chunk").agg(F.max(newest)["_v"].alias("_last"))
    before = F.last("_last", ignorenulls=True).over(key.across().rowsBetween(*BEFORE))
    context = chunks.select(*key.keys, "_chunk", before.alias("_carried"))
    local = F.last(column, ignorenulls=True).over(key.within().rowsBetween(*UP_TO))
    filled = _joined(rows.withColumn("_local", local), context, key)
    return filled.withColumn(out, F.coalesce("_local", "_carried")).select(*df.columns, out)


def position(df: DataFrame, key: SeriesKey, out: str = "position") -> DataFrame:
    """1-based position of each row in its series."""
    rows = chunked(df, key)
    chunks = rows.groupBy(*key.keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(key.across().rowsBetween(*BEFORE)), F.lit(0))
    context = chunks.select(*key.keys, "_chunk", before.alias("_offset"))
    numbered = rows.withColumn("_rn", F.row_number().over(key.within()))
    joined = _joined(numbered, context, key)
    offset = F.coalesce("_offset", F.lit(0))
    return joined.withColumn(out, offset + F.col("_rn")).select(*df.columns, out)


def interpolate(df: DataFrame, key: SeriesKey, column: str, out: str | None = None) -> DataFrame:
    """Linear interpolation by position: leading nulls stay, trailing nulls carry the last value."""
    out = out or f"{column}_interpolated"
    known = F.col(column).isNotNull()
    rows = chunked(df, key)
    rows = rows.withColumn("_rn", F.row_number().over(key.within()).cast("long"))
    spot = F.when(known, F.col("_rn"))
    chunks = rows.groupBy(*key.keys, "_chunk").agg(
        F.count("*").alias("_n"),
        F.min(spot).alias("_first_at"),
        F.max(spot).alias("_last_at"),
        F.min_by(column, spot).alias("_first_v"),
        F.max_by(column, spot).alias("_last_v"),
    )
    # Positions become global with the number of rows in the chunks before.
    offset = F.coalesce(F.sum("_n").over(key.across().rowsBetween(*BEFORE)), F.lit(0))
    chunks = chunks.withColumn("_offset", offset)
    has = F.col("_first_at").isNotNull()
    head = F.when(has, F.struct((F.col("_offset") + F.col("_first_at")).alias("at"), F.col("_first_v").alias("v")))
    tail = F.when(has, F.struct((F.col("_offset") + F.col("_last_at")).alias("at"), F.col("_last_v").alias("v")))
    context = chunks.select(
        *key.keys,
        "_chunk",
        "_offset",
        F.last(tail, ignorenulls=True).over(key.across().rowsBetween(*BEFORE)).alias("_prev_far"),
        F.last(head, ignorenulls=True).over(key.across(backwards=True).rowsBetween(*BEFORE)).alias("_next_far"),
    )
    here = F.when(known, F.struct(F.col("_rn").alias("at"), F.col(column).alias("v")))
    rows = rows.withColumns(
        {
            "_prev": F.last(here, ignorenulls=True).over(key.within().rowsBetween(*UP_TO)),
            "_next": F.last(here, ignorenulls=True).over(key.within(backwards=True).rowsBetween(*UP_TO)),
        }
    )
    joined = _joined(rows, context, key).withColumn("_offset", F.coalesce("_offset", F.lit(0)))

    def either(near: str, far: str) -> tuple[Column, Column]:
        at = F.coalesce(F.col(f"{near}.at") + F.col("_offset"), F.col(f"{far}.at"))
        return at, F.coalesce(F.col(f"{near}.v"), F.col(f"{far}.v"))

    (p_at, p_v), (n_at, n_v) = either("_prev", "_prev_far"), either("_next", "_next_far")
    here_at = F.col("_offset") + F.col("_rn")
    between = p_v + (n_v - p_v) * F.try_divide(here_at - p_at, n_at - p_at)
    value = F.when(known, F.col(column)).when(n_v.isNull(), p_v).otherwise(between)
    return joined.withColumn(out, value).select(*df.columns, out)


def lags(df: DataFrame, key: SeriesKey, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Columns ``out -> (column, k)`` with the value ``k`` rows earlier in the series, nulls included."""
    rows, reach = chunked(df, key), max(k for _, k in wanted.values())
    sources = list(dict.fromkeys(c for c, _ in wanted.values()))
    w = key.within()
    rows = rows.withColumns(
        {"_rn": F.row_number().over(w), **{f"_local_{out}": F.lag(c, k).over(w) for out, (c, k) in wanted.items()}}
    )
    # The last values of every chunk (at most ``reach`` of them), oldest first.
    kept = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(sources)])
    recent = (
        rows.select(*key.keys, "_chunk", *[c for c in key.order if c not in key.keys], kept.alias("_v"))
        .withColumn("_back", F.row_number().over(key.within(backwards=True)))
        .where(F.col("_back") <= reach)
    )
    tails = recent.groupBy(*key.keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("_v").alias("v")))).alias("_tail")
    )
    before = F.flatten(F.collect_list("_tail").over(key.across().rowsBetween(-reach, -1)))
    context = tails.select(*key.keys, "_chunk", before.alias("_before")).withColumn(
        "_halo", F.when(F.size("_before") > reach, F.slice("_before", -reach, reach)).otherwise(F.col("_before"))
    )
    joined = _joined(rows, context.drop("_before"), key)
    found = {}
    for out, (c, k) in wanted.items():
        needed = F.lit(k + 1) - F.col("_rn")  # how far back from the end of the halo
        item = F.when(F.size("_halo") >= needed, F.try_element_at(F.col("_halo"), (-needed).cast("int"))["v"][f"v{sources.index(c)}"])
        found[out] = F.when(F.col("_rn") > k, F.col(f"_local_{out}")).otherwise(item)
    return joined.withColumns(found).select(*df.columns, *wanted)


def lag(df: DataFrame, key: SeriesKey, column: str, k: int = 1, out: str | None = None) -> DataFrame:
    """Value ``k`` rows earlier in the series, nulls included."""
    return lags(df, key, {out or f"{column}_lag{k}": (column, k)})


def difference(df: DataFrame, key: SeriesKey, column: str, k: int = 1, out: str | None = None) -> DataFrame:
    """Difference to the value ``k`` rows earlier."""
    lagged = lag(df, key, column, k, "_lagged")
    return lagged.withColumn(out or f"{column}_diff{k}", F.col(column) - F.col("_lagged")).drop("_lagged")


# --- bounded selections ------------------------------------------------------


def newest(
    df: DataFrame,
    key: SeriesKey,
    n: int,
    rank: str | None = None,
    oldest: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """The last (or first) ``n`` rows of every series, optionally with their rank.

    Two rounds: the best ``n`` of every slice of a series, then the best ``n`` of those.  A slice
    is a set of input partitions, so the group limit Spark derives from the rank filter leaves at
    most ``n`` rows of a series per input task before the first shuffle.  There are about as
    many slices as the root of the number of input partitions, so neither round brings more than
    that many times ``n`` rows of a series together.  The slices do not influence the result.
    """
    out = rank or "_rank"
    slices = slices or max(8, math.isqrt(df.rdd.getNumPartitions()))
    order = [F.col(c).asc() if oldest else F.col(c).desc() for c in key.order]
    slice_of = F.spark_partition_id() % F.lit(slices)
    first = Window.partitionBy(*key.keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*key.keys).orderBy(*order)
    cut = (
        df.withColumn("_slice", slice_of)
        .withColumn("_slice_rank", F.row_number().over(first))
        .where(F.col("_slice_rank") <= n)
        .drop("_slice", "_slice_rank")
    )
    ranked = cut.withColumn(out, F.row_number().over(final)).where(F.col(out) <= n)
    return ranked if rank else ranked.drop(out)


def snapshot(df: DataFrame, key: SeriesKey, n: int = 100) -> DataFrame:
    """The latest ``n`` rows of all series together (a top-k, no full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in key.order]).limit(n)


def budget_split(
    df: DataFrame, key: SeriesKey, row_id: str, max_requests: int = 5, window_seconds: float = 60.0
) -> DataFrame:
    """Request budget: the first N rows per key and window are real, the rest rate limited.

    The admitted ids are found with :func:`newest` per (key, window) and joined back on the
    unique row id, so a window that holds most of the rows is still spread over all tasks.
    """
    width = int(window_seconds * 1_000_000)
    windowed = df.withColumn("_window", floor_to(F.col(key.ts), width))
    slot = SeriesKey((*key.keys, "_window"), key.ts, key.tie or (row_id,))
    admitted = newest(
        windowed.select(row_id, *dict.fromkeys([*slot.keys, *slot.order])), slot, max_requests, oldest=True
    ).select(row_id, F.lit(True).alias("_admitted"))
    joined = df.join(admitted.withColumnRenamed(row_id, "_id"), F.col(row_id).eqNullSafe(F.col("_id")), "left").drop("_id")
    real = F.col("_admitted").isNotNull()
    return joined.withColumns(
        {
            "data_type": F.when(real, F.lit("real")).otherwise(F.lit("synthetic")),
            "reason": F.when(~real, F.lit("rate_limited")),
        }
    ).drop("_admitted")


# --- history -----------------------------------------------------------------


def append_history(history: DataFrame, batch: DataFrame) -> DataFrame:
    """History with a batch appended; columns either side lacks are null."""
    return history.unionByName(batch, allowMissingColumns=True)


def deduplicated(df: DataFrame, key: SeriesKey, newest_by: str) -> DataFrame:
    """One row per (series, time): the one with the greatest ``newest_by``."""
    names = [*key.keys, key.ts]
    rest = [c for c in df.columns if c not in names]
    best = F.max_by(F.struct(*rest), F.col(newest_by)).alias("_row")
    return df.groupBy(*names).agg(best).select(*names, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(
        *df.columns
    )


def ordered(df: DataFrame, key: SeriesKey, columns: Sequence[str] | None = None) -> DataFrame:
    """Projection of a series in time order (a range-partitioned sort at output only)."""
    frame = df.select(*columns) if columns else df
    return frame.orderBy(*key.order)


def knocked_out(df: DataFrame, column: str, seed: int, share: float, row_id: str, out: str) -> DataFrame:
    """Copy of a column with a keyed share of its values missing (to exercise repairs)."""
    gone = rng.uniform(seed, column, "outage", row_id) < F.lit(share)
    return df.withColumn(out, F.when(~gone, F.col(column)))


# --- resampling --------------------------------------------------------------


def ohlcv(
    df: DataFrame, key: SeriesKey, value: str, volume: Column, bucket: Column, bucket_name: str = "bucket"
) -> DataFrame:
    """Open, high, low, close and volume per series and bucket.

    All aggregates combine on the map side, so a hot series or bucket shuffles one row per task.
    """
    order = F.struct(*key.order) if key.tie else F.col(key.ts)  # one plain column aggregates by hash
    return df.groupBy(*key.keys, bucket.alias(bucket_name)).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.sum(volume).alias("volume"),
    )
