import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import rng


def test_column_equals_driver_value(spark):
    ids = [0, 1, 5, -7, 2**31 - 1, 2**40 + 3, 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = df.select(
        "id",
        rng.uniform(7, "f", "value", "id", 3).alias("u"),
        rng.normal(7, "f", "value", "id").alias("z"),
    ).collect()
    for row in got:
        assert row.u == rng.uniform_value(7, "f", "value", row.id, 3)
        assert math.isclose(row.z, rng.normal_value(7, "f", "value", row.id), rel_tol=1e-12, abs_tol=1e-12)


def test_moments_and_independence(spark):
    df = spark.range(100_000).select(
        rng.uniform(1, "a", "value", "id").alias("a"),
        rng.uniform(1, "b", "value", "id").alias("b"),
        rng.normal(1, "a", "value", "id").alias("z"),
    )
    pdf = df.toPandas()
    assert pdf.a.between(0, 1, inclusive="left").all()
    assert abs(pdf.a.mean() - 0.5) < 0.005 and abs(pdf.a.std() - 12**-0.5) < 0.005
    assert abs(pdf.z.mean()) < 0.02 and abs(pdf.z.std() - 1) < 0.01
    assert abs(np.corrcoef(pdf.a, pdf.b)[0, 1]) < 0.01
    assert abs(np.corrcoef(pdf.a[1:], pdf.a[:-1])[0, 1]) < 0.01
    counts = np.histogram(pdf.a, 50, (0, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() < 100  # 49 degrees of freedom


@pytest.mark.parametrize("partitions", [2, 7])
def test_partitioning_does_not_matter(spark, partitions):
    def rows(n):
        ids = spark.range(0, 1000, 1, n)
        return {tuple(r) for r in ids.select("id", rng.normal(3, "x", "value", "id")).collect()}

    assert rows(1) == rows(partitions)


def test_indices_cover_their_pools(spark):
    a, b = rng.indices(1, "f", "value", (3, 5), "id")
    counts = spark.range(15_000).select(a.alias("a"), b.alias("b")).groupBy("a", "b").count().collect()
    assert len(counts) == 15 and all(800 < r["count"] < 1200 for r in counts)


def test_null_id_is_zero(spark):
    row = spark.sql("select cast(null as bigint) as id").select(rng.uniform(1, "f", "v", "id").alias("u")).first()
    assert row.u == rng.uniform_value(1, "f", "v", 0)


def test_text_id_is_stable(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "s string").select(F.expr(rng.text_id("s"))).collect()
    assert ids[0] == ids[2] != ids[1]


def test_all_bits_of_an_id_count(spark):
    """Ids that share their low or high half, or differ by a prime, give other rows."""
    steps = [2147483629, 1 << 31, 1 << 32, 1 << 40, -(1 << 33)]
    df = spark.range(1000).withColumns({f"u{k}": rng.uniform(1, "f", "value", f"id + {step}L") for k, step in enumerate([0, *steps])})
    rows = df.collect()
    for k in range(1, len(steps) + 1):
        assert sum(r["u0"] == r[f"u{k}"] for r in rows) == 0
    assert all(abs(r["u2"] - rng.uniform_value(1, "f", "value", r["id"] + (1 << 31))) < 1e-15 for r in rows)
