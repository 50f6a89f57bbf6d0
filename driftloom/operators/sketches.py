"""Profiles that merge: one small row per column and batch, from which the profile of all batches follows.

Counts, bounds and moments merge exactly (up to rounding); distinct values and the median come from sketches
of a bounded size, which any number of merges keeps.  A new batch is read once, and a table that has grown to
many batches is profiled from the stored rows alone.  The exact forms are in ``operators.profile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.scalars import missing_sql, numeric_columns, present_sql, sql_text

# Distinct values: 2 ** DISTINCT_LG registers, a standard error of 1.04 / sqrt(2 ** DISTINCT_LG), here 0.8 %.
DISTINCT_LG = 14
# Median: by its published bound, a sketch of this size has a rank error of about 0.35 % of the rows (in 99 of 100 cases).
RANKS_K = 1000
METRICS = ("null_count", "unique_count", "min", "max", "mean", "std", "median")


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, in one aggregate over one scan; nothing but these rows is shuffled.

    ``rows``, ``null_count`` (NaN counts as missing) and ``distinct`` for every column; ``n``, ``min``, ``max``,
    ``total``, ``m2`` (sum of squared deviations) and ``ranks`` for numeric ones, where a column without values
    has nulls.  Equal values count once whatever their zero's sign.  An empty table gives rows with counts of 0.
    """
    columns, numeric = list(columns or df.columns), set(numeric_columns(df))
    stats = []
    for c in columns:
        value = present_sql(df, c)
        hashed = f"if({missing_sql(df, c)}, null, xxhash64({f'{value} + 0' if c in numeric else value}))"
        number = f"({present_sql(df, c, 'double')} + 0.0D)" if c in numeric else "cast(null as double)"
        stats.append(
            f"""named_struct('column', {sql_text(c)}, 'dtype', '{df.schema[c].dataType.simpleString()}',
                'rows', count(*), 'null_count', count_if({missing_sql(df, c)}), 'distinct', hll_sketch_agg({hashed}, {DISTINCT_LG}),
                'n', count({number}), 'min', min({number}), 'max', max({number}), 'total', sum({number}),
                'm2', var_pop({number}) * count({number}), 'ranks', kll_sketch_agg_double({number}, {RANKS_K}))"""
        )
    return df.agg(F.expr(f"array({', '.join(stats)})").alias("s")).select(F.inline("s"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of any batches merged per column and type, again as states: in any order, in one step or many."""
    here = Window.partitionBy("column", "dtype")
    # Deviations are taken from the common mean before they are squared, so large means cost no digits.
    centre = F.try_divide(F.sum("total").over(here), F.sum("n").over(here))
    off = F.try_divide(F.col("total"), F.col("n")) - F.col("_centre")
    apart = F.col("m2") + F.col("n") * off * off
    return states.withColumn("_centre", centre).groupBy("column", "dtype").agg(
        F.sum("rows").alias("rows"),
        F.sum("null_count").alias("null_count"),
        F.expr("hll_union_agg(distinct)").alias("distinct"),
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("total").alias("total"),
        F.sum(apart).alias("m2"),
        F.expr(f"kll_merge_agg_double(ranks, {RANKS_K})").alias("ranks"),
    )


def report(states: DataFrame) -> DataFrame:
    """Long-form profile ``(column, metric, value)`` of merged states; metrics a column lacks give no row.

    ``unique_count`` is an estimate and ``median`` a value near the middle rank.
    """
    std = F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))
    median = F.when(F.col("n") > 0, F.expr("kll_sketch_get_quantile_double(ranks, 0.5D)"))
    wide = states.withColumns(
        {"unique_count": F.expr("hll_sketch_estimate(distinct)"), "mean": F.try_divide("total", "n"), "std": std, "median": median}
    ).select("column", *[F.col(m).cast("double").alias(m) for m in METRICS])
    return wide.unpivot("column", list(METRICS), "metric", "value").where("value is not null")


def save_state(states: DataFrame, path: str, version: int) -> None:
    """Store the state of a batch; storing a version again replaces just that one."""
    states.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """The stored states of all batches."""
    return spark.read.parquet(path).drop("version")
