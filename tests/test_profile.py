import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import profile as p
from driftloom.operators import sketches
from driftloom.operators.conformance import conformance
from driftloom.schema import TableSpec


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(3)
    n = 5001
    return pd.DataFrame(
        {
            "normal": r.normal(size=n),
            "skewed": np.where(r.random(n) < 0.7, 1.0, r.exponential(1000, n)),
            "gaps": np.where(r.random(n) < 0.3, np.nan, r.integers(0, 50, n)),
            "constant": 4.0,
            "whole": r.integers(-5, 5, n),
            "text": r.choice(["x", "y", "z"], n),
            "name": [f"n{i}" for i in range(n)],
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("rows", [5001, 5000, 2, 1])
def test_exact_medians(spark, frame, rows):
    part = frame.head(rows)
    got = {r.column: r.median for r in p.medians(spark.createDataFrame(part).repartition(3)).collect()}
    want = part.select_dtypes("number").median().dropna()
    assert got == pytest.approx(want.to_dict())


def test_medians_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert p.medians(df).count() == 0


def test_counts_and_moments(df, frame):
    counts = p.column_counts(df).toPandas().set_index("column")
    assert counts.unique_count.to_dict() == frame.nunique().to_dict()
    assert counts.null_count.to_dict() == frame.isna().sum().to_dict()
    moments = p.moments(df).toPandas().set_index("column")
    numbers = frame.select_dtypes("number")
    for name, want in (("min", numbers.min()), ("max", numbers.max()), ("mean", numbers.mean()), ("std", numbers.std())):
        assert np.allclose(moments[name].loc[want.index], want)


def test_approximate_counts_are_close(df, frame):
    counts = p.column_counts(df, approximate=True).toPandas().set_index("column")
    assert abs(counts.unique_count["name"] - 5001) < 600 and counts.unique_count["text"] == 3


def test_long_profile(df):
    rows = p.profile(df).toPandas().pivot(index="column", columns="metric", values="value")
    assert rows.loc["constant", "std"] == 0 and rows.loc["text", "unique_count"] == 3
    assert np.isnan(rows.loc["text", "median"])


def test_value_counts_gate(df, frame):
    rows = p.value_counts(df).toPandas()
    assert set(rows.column) == {"text"}
    assert rows.set_index("value").n.to_dict() == frame.text.value_counts().to_dict()


@pytest.mark.parametrize("column", ["normal", "skewed", "constant"])
def test_histogram(df, frame, column):
    rows = p.histogram(df, column).toPandas().sort_values("bin")
    counts, edges = np.histogram(frame[column], 20)
    assert rows.n.sum() == len(frame) and len(rows) == 20
    assert np.abs(rows.n.to_numpy() - counts).sum() <= 2  # a value on an edge may fall either way
    assert np.allclose(rows.left_edge, edges[:-1])


def test_conformance(spark):
    spec = TableSpec.of(
        "t",
        {
            "x": {"type": "float", "min": 0, "max": 1},
            "c": {"type": "category", "categories": ["a", "b"]},
            "gone": {"type": "int"},
        },
    )
    df = spark.createDataFrame([("0.5", "a"), ("2", "a"), ("bad", "q"), (None, None)], "x string, c string")
    got = {(r.field, r.rule): r.violations for r in conformance(df, spec).collect()}
    assert got == {
        ("x", "not_null"): 1, ("x", "type"): 1, ("x", "min"): 0, ("x", "max"): 1,
        ("c", "not_null"): 1, ("c", "known_category"): 1, ("c", "category_share"): 2,
        ("gone", "present"): 1,
    }


def test_generated_rows_conform(spark):
    from driftloom.operators.generate import generate, row_ids
    from driftloom.schema import PRESET_TABULAR

    spec = TableSpec.of("t", PRESET_TABULAR)
    report = conformance(generate(row_ids(spark, 5000), spec), spec)
    assert report.agg(F.sum("violations")).first()[0] == 0


def test_merged_profile_equals_that_of_the_whole(spark):
    """Exact metrics agree, sketches keep their errors, merging is associative, and odd columns are defined."""
    rows = spark.range(40_000).select(
        "id",
        ((F.col("id") * 7919) % 9001).cast("double").alias("x"),
        F.when(F.col("id") % 10 != 0, 1e9 + F.rand(5)).alias("far"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 2 * 0.0 - 0.0).alias("zero"),
        F.concat(F.lit("it's "), (F.col("id") % 17).cast("string")).alias("a'b"),
        F.lit(None).cast("int").alias("none"),
        F.timestamp_micros(F.col("id") * 1000).alias("at"),
        (F.col("id") % 5).cast("decimal(10,2)").alias("price"),
    )
    cuts = [rows.where("id < 9"), rows.where("id >= 9 and id < 20000"), rows.where("id >= 20000"), rows.limit(0)]
    one, two, three, none = (sketches.profile_state(c) for c in cuts)
    at_once = sketches.merge_states(one.unionByName(two).unionByName(three).unionByName(none))
    by_steps = sketches.merge_states(sketches.merge_states(none.unionByName(one).unionByName(two)).unionByName(three))
    exact = {(r.column, r.metric): r.value for r in p.profile(rows).collect()}
    for states in (at_once, by_steps, sketches.profile_state(rows)):
        got = {(r.column, r.metric): r.value for r in sketches.report(states).collect()}
        assert set(got) == set(exact)
        for (column, metric), value in got.items():
            wanted = exact[column, metric]
            if metric == "unique_count":
                assert value == pytest.approx(wanted, rel=0.04, abs=0.5), column
            elif metric == "median":
                spread = exact[column, "max"] - exact[column, "min"]
                assert abs(value - wanted) <= 0.02 * spread + (1 if column == "price" else 0), column
            else:
                assert value == pytest.approx(wanted, rel=1e-9 if metric != "std" else 1e-5), (column, metric)
