"""Profiles of tables: counts, moments, exact medians, value counts and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.scalars import missing_sql, numeric_columns, present_sql, sql_text, text_columns
from driftloom.session import cut_lineage

# Quantile sketch: rank error at most n / ACCURACY; the bracket is five times as wide on each side.
ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY
BUCKETS = 1024
# Text columns with at most this many distinct values get value counts.
VALUE_COUNT_LIMIT = 10


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count("*").alias("record_count")).select(
        "record_count", F.lit(len(df.columns)).cast("long").alias("column_count")
    )


def _kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the type their values are compared in."""
    kinds: dict[str, list[str]] = {}
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, T.IntegralType):
            kind = "bigint"
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            kind = "double"
        elif isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
            kind = t.simpleString()
        else:
            kind = "string"
        kinds.setdefault(kind, []).append(c)
    return kinds


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column`` (its position), one value field per type, and ``n``: one grouping per type.

    Values keep their type, in the field ``v_<type>``; a missing value has none.  Each type is grouped
    by itself, so keys are plain values and every scan reads the columns of its type only.  Duplicates
    combine on the map side, so the shuffle carries distinct values, and a value that fills a third of
    the table costs one row per task.
    """
    columns, kinds = list(columns), _kinds(df, columns)
    parts = []
    for kind, names in kinds.items():
        pairs = [f"named_struct('column', {columns.index(c)}, 'v', {present_sql(df, c, kind)})" for c in names]
        counted = df.selectExpr(f"inline(array({', '.join(pairs)}))").groupBy("column", "v").agg(F.count("*").alias("n"))
        values = [(F.col("v") if k == kind else F.lit(None).cast(k)).alias(f"v_{k}") for k in kinds]
        parts.append(counted.select("column", *values, "n"))
    return reduce(DataFrame.unionByName, parts)


def _counted(counts: DataFrame) -> DataFrame:
    """Missing and distinct values per column of a table of :func:`frequencies`."""
    there = reduce(or_, [F.col(c).isNotNull() for c in counts.columns if c.startswith("v_")])
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("null_count"), F.count_if(there).alias("unique_count")
    )


def _named(columns: Sequence[str]) -> Column:
    """Column name of a position."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1)


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type, missing values (NaN counts) and distinct values (missing excluded).

    Exact distincts go through :func:`frequencies`; ``approximate=True`` uses one sketch per
    column and no shuffle of values, the choice for very wide or very large tables.
    """
    columns = list(columns or df.columns)
    types = [df.schema[c].dataType.simpleString() for c in columns]
    if approximate:
        stats = [
            f"""named_struct('column', {sql_text(c)}, 'dtype', '{t}', 'null_count', count_if({missing_sql(df, c)}),
                'unique_count', approx_count_distinct({present_sql(df, c)}))"""
            for c, t in zip(columns, types)
        ]
        return df.agg(F.expr(f"array({', '.join(stats)})").alias("s")).select(F.inline("s"))
    merged = _counted(frequencies(df, columns))
    dtype = F.element_at(F.array(*[F.lit(t) for t in types]), F.col("column") + 1)
    return merged.select(_named(columns).alias("column"), dtype.alias("dtype"), "null_count", "unique_count")


def _moment_fields(v: str) -> str:
    return f"'min', min({v}), 'max', max({v}), 'mean', avg({v}), 'std', stddev_samp({v})"


def _bracket_fields(v: str) -> str:
    ends = f"percentile_approx({v}, array({0.5 - MARGIN}D, {0.5 + MARGIN}D), {ACCURACY})"
    return f"'n', count({v}), 'lo', {ends}[0], 'hi', {ends}[1]"


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: min, max, mean and sample standard deviation, in one aggregate."""
    names = columns or numeric_columns(df)
    stats = [f"named_struct('column', {sql_text(c)}, {_moment_fields(present_sql(df, c, 'double'))})" for c in names]
    return df.agg(F.expr(f"array({', '.join(stats)})").alias("s")).select(F.inline("s"))


# --- exact medians -----------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact median per numeric column, with no task that holds a whole column.

    1. One quantile sketch per column (bounded size, merged on the map side) brackets the two
       middle ranks.
    2. One pass counts the values below the bracket and groups those inside it into equal-width
       buckets of distinct values; everything combines before the shuffle.
    3. Running totals over at most ``BUCKETS + 1`` rows per column find the buckets that hold
       the middle ranks, and only the values of these are ordered.

    The result is exact whatever the sketch answered: if a middle rank ever fell outside its
    bracket, the query fails rather than returning another value.
    """
    columns = list(columns or numeric_columns(df))
    brackets = [f"named_struct('column', {i}, {_bracket_fields(present_sql(df, c, 'double'))})" for i, c in enumerate(columns)]
    state = df.agg(F.expr(f"array({', '.join(brackets)})").alias("s")).select(F.inline("s"))
    pairs = [f"named_struct('column', {i}, 'v', cast(`{c}` as double))" for i, c in enumerate(columns)]
    values = df.selectExpr(f"inline_outer(array({', '.join(pairs)}))").withColumn("n", F.lit(1))
    return _medians(values, state).select(_named(columns).alias("column"), "median")


def _medians(values: DataFrame, state: DataFrame) -> DataFrame:
    """Medians of weighted ``values`` (column, v, n) inside the brackets of ``state`` (column, n, lo, hi)."""
    state = state.where("n > 0").select("column", "lo", "hi", F.expr("(n + 1) div 2").alias("r1"), F.expr("n div 2 + 1").alias("r2"))
    values = values.where("v is not null and not isnan(v)")
    # One row of state per numeric column of the schema: the broadcast is bounded by the schema.
    inside = values.join(F.broadcast(state), "column").where("v <= hi")
    slot = F.least(
        F.lit(BUCKETS - 1),
        F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * BUCKETS),
    )
    below = F.col("v") < F.col("lo")
    counted = inside.groupBy(
        "column",
        "r1",
        "r2",
        F.when(below, F.lit(-1)).otherwise(slot).cast("int").alias("bucket"),
        F.when(~below, F.col("v")).alias("v"),
    ).agg(F.sum("n").alias("n"))
    totals = counted.groupBy("column", "r1", "r2", "bucket").agg(F.sum("n").alias("total"))
    upto = F.sum("total").over(Window.partitionBy("column").orderBy("bucket"))
    hit = totals.withColumn("before", upto - F.col("total")).where(
        "(before < r1 and r1 <= before + total) or (before < r2 and r2 <= before + total)"
    )
    # At most two buckets per column.
    chosen = counted.join(F.broadcast(hit.select("column", "bucket", "before")), ["column", "bucket"])
    order = Window.partitionBy("column", "bucket").orderBy("v")
    last = F.col("before") + F.sum("n").over(order)
    ranked = chosen.withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("first") < F.col(rank)) & (F.col(rank) <= F.col("last")), F.col("v")))

    found = ranked.groupBy("column").agg(((at("r1") + at("r2")) / 2).alias("median"))
    checked = F.coalesce("median", F.raise_error(F.lit("median outside its sketch bracket")).cast("double"))
    return found.select("column", checked.alias("median"))


# --- long form, value counts, histograms --------------------------------------

PROFILE_METRICS = ("null_count", "unique_count", "min", "max", "mean", "std", "median")


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Long-form profile ``(column, metric, value)``; metrics a column lacks give no row.

    Two scans: one aggregate for moments and median brackets, and one pass of value frequencies,
    from which the counts and, inside the brackets, the medians follow.
    """
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_columns(df) if c in columns]
    at = columns.index
    if approximate:
        wide = column_counts(df, columns, True).drop("dtype")
        if numeric:
            wide = wide.join(moments(df, numeric), "column", "left").join(medians(df, numeric), "column", "left")
    else:
        counts = cut_lineage(frequencies(df, columns))
        wide = _counted(counts)
        if numeric:
            stats = [
                f"named_struct('column', {at(c)}, {_moment_fields(v)}, {_bracket_fields(v)})" for c in numeric for v in [present_sql(df, c, "double")]
            ]
            state = cut_lineage(df.agg(F.expr(f"array({', '.join(stats)})").alias("s")).select(F.inline("s")))
            numbers = [F.col(f"v_{k}").cast("double") for k in ("bigint", "double") if f"v_{k}" in counts.columns]
            mine = F.col("column").isin([at(c) for c in numeric])
            if len(numbers) and all(t in ("bigint", "double") for t in _kinds(df, numeric)):
                values = counts.where(mine).select("column", F.coalesce(*numbers).alias("v"), "n")
                middle = _medians(values, state)
            else:  # decimals are compared as text
                named = F.map_from_arrays(F.array(*[F.lit(c) for c in numeric]), F.array(*[F.lit(at(c)) for c in numeric]))
                middle = medians(df, numeric).select(F.element_at(named, F.col("column")).alias("column"), "median")
            wide = wide.join(state.drop("n", "lo", "hi"), "column", "left").join(middle, "column", "left")
        wide = wide.withColumn("column", _named(columns))
    present = [m for m in PROFILE_METRICS if m in wide.columns]
    wide = wide.select("column", *[F.col(m).cast("double").alias(m) for m in present])
    return wide.unpivot("column", present, "metric", "value").where("value is not null")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, limit: int = VALUE_COUNT_LIMIT) -> DataFrame:
    """Counts of every value of the text columns with at most ``limit`` distinct values.

    A distinct-count sketch rules out columns that are far above the limit, so that their values
    are never shuffled.  It cannot rule out a column at or below the limit: that few values set
    that few sketch registers.  The exact gate follows.
    """
    columns = list(columns or text_columns(df))
    sketch = df.agg(F.struct(*[F.approx_count_distinct(_c(c)).alias(c) for c in columns])).scalar()
    pairs = [
        F.when(
            sketch.getField(c) <= F.lit(100 * limit),
            F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")),
        )
        for c in columns
    ]
    kept = df.select(F.explode(F.array(*pairs)).alias("p")).where("p.value is not null")
    counts = kept.groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("_d")).where(F.col("_d") <= limit)
    # One row per text column of the schema.
    return counts.join(F.broadcast(few.select("column")), "column", "left_semi")


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first."""
    counts = df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "value")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram of the finite values with all bins present; the maximum falls into the last bin."""
    value = _c(column).cast("double")
    present = df.where(f"not {missing_sql(df, column)}").where(F.abs(value) < float("inf")).select(value.alias("v"))
    ends = present.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    flat = ends["lo"] == ends["hi"]
    lo = F.when(flat, ends["lo"] - 0.5).otherwise(ends["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(ends["hi"] - ends["lo"]) / F.lit(float(bins))
    # ``bin`` is 1-based; the scalar ends are literals at run time, the count is one aggregate.
    numbered = present.select(
        F.least(F.lit(bins), F.floor((F.col("v") - lo) / width).cast("int") + 1).alias("bin")
    )
    counts = numbered.groupBy("bin").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (lo + width * (F.col("bin") - 1)).alias("left_edge"),
        (lo + width * F.col("bin")).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
