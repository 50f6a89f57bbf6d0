from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift as d
from driftloom.operators import generate as g
from driftloom.schema import CUSTOMER_SCHEMA, PRESET_SERIES, TRANSACTION_SCHEMA, SpecError, TableSpec

TABULAR = {
    "id": {"type": "int", "min": 1000, "max": 9999},
    "value": {"type": "float", "mean": 100, "std": 15, "min": 0},
    "category": {"type": "category", "categories": ["A", "B", "C"], "probabilities": [0.5, 0.3, 0.2]},
}


def test_tabular_batch(spark):
    spec = TableSpec.of("t", TABULAR)
    df = g.generate(g.row_ids(spark, 100), spec).toPandas()
    assert len(df) == 100 and list(df.columns) == ["id", "value", "category"]
    assert df.id.between(1000, 9999).all() and (df.value >= 0).all()
    assert set(df.category) <= {"A", "B", "C"}


def test_moments_and_shares(spark):
    df = g.generate(g.row_ids(spark, 50_000), TableSpec.of("t", TABULAR)).toPandas()
    assert abs(df.value.mean() - 100) < 0.5 and abs(df.value.std() - 15) < 0.3
    shares = df.category.value_counts(normalize=True)
    assert all(abs(shares[c] - p) < 0.01 for c, p in zip("ABC", (0.5, 0.3, 0.2)))


def test_clip_piles_mass_at_the_bounds(spark):
    spec = TableSpec.of("t", {"x": {"type": "float", "mean": 0, "std": 1, "min": -0.5, "max": 0.5}})
    df = g.generate(g.row_ids(spark, 10_000), spec).toPandas()
    assert df.x.min() == -0.5 and df.x.max() == 0.5
    assert 0.28 < (df.x == 0.5).mean() < 0.34


def test_batches_are_slices_of_one_sequence(spark):
    spec = TableSpec.of("t", TABULAR)
    whole = g.generate(g.row_ids(spark, 100), spec, keep=["row_id"]).collect()
    parts = [g.generate(g.row_ids(spark, 50, start), spec, keep=["row_id"]).collect() for start in (0, 50)]
    assert sorted(whole) == sorted(parts[0] + parts[1])


def test_seed_changes_values(spark):
    rows = [g.generate(g.row_ids(spark, 20), TableSpec.of("t", TABULAR, seed)).collect() for seed in (1, 2)]
    assert rows[0] != rows[1]


def test_identity_fields_and_unknown_type(spark):
    schema = {"n": {"type": "name"}, "e": {"type": "email"}, "a": {"type": "address"}, "u": {"type": "blob"}}
    df = g.generate(g.row_ids(spark, 200), TableSpec.of("t", schema)).toPandas()
    assert df.n.str.match(r"^\w+ \w+$").all()
    assert df.e.str.match(r"^[a-z]+\.[a-z]+\d+@example\.(com|net|org)$").all()
    assert df.a.str.match(r"^\d+ [\w ]+, \w+, [A-Z]{2} \d{5}$").all()
    assert df.u.isna().all()


def test_custom_field_type(spark):
    g.register_field_type("coin", lambda spec, draws: F.when(draws.uniform() < 0.5, "heads").otherwise("tails"))
    try:
        df = g.generate(g.row_ids(spark, 100), TableSpec.of("t", {"c": {"type": "coin"}})).toPandas()
    finally:
        del g.FIELD_TYPES["coin"]
    assert set(df.c) == {"heads", "tails"}


def test_unused_fields_are_pruned(spark):
    df = g.generate(g.row_ids(spark, 10), TableSpec.of("t", TABULAR)).select("id")
    assert "category" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_series(spark):
    spec = TableSpec.of("s", PRESET_SERIES)
    df = g.generate_series(g.row_ids(spark, 100), spec, "2024-01-01", 100).toPandas()
    assert len(df) == 100 and set(df.columns) == {"timestamp", "value", "count", "category"}
    assert df.timestamp.is_monotonic_increasing and df.timestamp[1] - df.timestamp[0] == timedelta(seconds=300)


def test_series_is_continuous_over_batches(spark):
    spec = TableSpec.of("s", PRESET_SERIES)
    second = g.generate_series(g.row_ids(spark, 10, 10), spec, "2024-01-01", 10).agg(F.min("timestamp")).first()[0]
    assert second == datetime(2024, 1, 1) + timedelta(seconds=3000)


def test_trend_restarts_and_size_one(spark):
    ids = g.row_ids(spark, 20).orderBy("row_id")
    trend = {"strength": 1.0}
    values = [r[0] for r in ids.select(g.with_trend(F.lit(0.0), trend, F.col("row_id"), 10)).collect()]
    assert values[0] == values[10] == 0.0 and values[9] == values[19] == 1.0
    single = ids.select(g.with_trend(F.lit(5.0), trend, F.col("row_id"), 1)).collect()
    assert {r[0] for r in single} == {5.0}


def test_generator_set(spark):
    generators = g.GeneratorSet()
    for name, schema in (("customers", CUSTOMER_SCHEMA), ("transactions", TRANSACTION_SCHEMA)):
        generators.add(TableSpec.of(name, schema))
    ids = g.row_ids(spark, 50)
    frames = generators.batch(ids, 50)
    assert {n: f.count() for n, f in frames.items()} == {"customers": 50, "transactions": 50}
    assert list(generators.batch(ids, 50, "customers")) == ["customers"]
    assert generators.batch(ids, 50, "nobody") == {}
    merged = g.union_batches(frames)
    assert merged.count() == 100 and merged.where("generator = 'customers' and price is null").count() == 50
    generators.remove("customers")
    assert list(generators.batch(ids, 50)) == ["transactions"]
    assert frames["customers"].schema["is_premium"].dataType.simpleString() == "boolean"


def test_a_broken_generator_is_skipped(spark):
    generators = g.GeneratorSet()
    generators.add(TableSpec.of("good", TABULAR))
    g.register_field_type("bad", lambda spec, draws: (_ for _ in ()).throw(ValueError("no")))
    try:
        generators.add(TableSpec.of("broken", {"x": {"type": "bad"}}))
        assert list(generators.batch(g.row_ids(spark, 5), 5)) == ["good"]
    finally:
        del g.FIELD_TYPES["bad"]


def test_stamp_keeps_event_time(spark):
    df = g.generate_series(g.row_ids(spark, 5), TableSpec.of("s", PRESET_SERIES), "2024-01-01", 5)
    stamped = g.stamp(df, "s")
    assert stamped.agg(F.max("timestamp")).first()[0].year == 2024
    assert {"generator", "emitted_at"} <= set(stamped.columns)


@pytest.mark.parametrize(
    "schema, words",
    [
        ({"x": {"type": "float", "std": -1}}, "std"),
        ({"x": {"type": "float", "mean": "a"}}, "mean"),
        ({"x": {"type": "int", "min": 5, "max": 1}}, "above max"),
        ({"x": {"type": "int", "min": 1.5}}, "integer"),
        ({"x": {"type": "category", "categories": []}}, "non-empty"),
        ({"x": {"type": "category", "categories": ["a", 1]}}, "one type"),
        ({"x": {"type": "category", "categories": ["a", "b"], "probabilities": [0.5]}}, "match"),
        ({"x": {"type": "category", "categories": ["a", "b"], "probabilities": [0.5, 0.2]}}, "sum"),
        ({"x": {"type": "datetime", "start_date": 5}}, "dates"),
        ({"x": {"type": "datetime", "start_date": "someday"}}, "ISO"),
        ({"x": "float"}, "mapping"),
        ({"time_field": 3, "x": {}}, "time_field"),
        ({"time_field": "t", "time_interval_seconds": "x"}, "time_interval_seconds"),
    ],
)
def test_bad_specifications(schema, words):
    with pytest.raises(SpecError, match=words):
        TableSpec.of("t", schema)


# --- drift -------------------------------------------------------------------


def test_drift_keeps_shape_and_changes_values(spark):
    spec = TableSpec.of("t", TABULAR)
    df = g.generate(g.row_ids(spark, 100), spec, keep=["row_id"])
    before, after = df.toPandas(), d.drift(df, spec, 0.5).toPandas()
    assert list(before.columns) == list(after.columns) and len(before) == len(after)
    assert (before.id == after.id).all() and (before.value != after.value).any()
    assert (after.value >= 0).all()
    moved = (after.value - before.value)[after.value > 0].round(6).unique()
    assert set(abs(moved)) == {7.5}


def test_category_drift_needs_an_open_gate(spark):
    spec = TableSpec.of("t", TABULAR)
    df = g.generate(g.row_ids(spark, 2000), spec, keep=["row_id"])
    closed = next(e for e in range(100) if not d.gate_open(spec.seed, "category", 0.5, e))
    opened = next(e for e in range(100) if d.gate_open(spec.seed, "category", 0.5, e))
    before = df.toPandas().category
    assert (d.drift(df, spec, 0.5, event=closed).toPandas().category == before).all()
    changed = (d.drift(df, spec, 0.5, event=opened).toPandas().category != before).mean()
    assert 0.1 < changed < 0.5  # half of the rows are drawn again, some to the same value


def test_null_passes_through_drift(spark):
    spec = TableSpec.of("t", {"value": {"type": "float", "min": 0, "max": 1}})
    df = spark.createDataFrame([(0, None), (1, 0.5)], "row_id bigint, value double")
    rows = {r.row_id: r.value for r in d.drift(df, spec, 0.9).collect()}
    assert rows[0] is None and rows[1] is not None


def test_scheduled_drift_equals_literal_drift(spark):
    """Event parameters computed as columns give the same rows as the driver-side literals."""
    spec = TableSpec.of("t", TABULAR)
    rows = g.generate(g.row_ids(spark, 400), spec, keep=["row_id"]).withColumns(
        {
            "batch": F.floor(F.col("row_id") / 100).cast("long"),
            "ts": F.timestamp_add("SECOND", F.col("row_id"), F.lit("2024-01-01").cast("timestamp_ntz")),
        }
    )
    origin = F.lit(int(datetime(2024, 1, 1).timestamp() - datetime(1970, 1, 1).timestamp()) * 1_000_000)
    out = d.drift_on_schedule(rows, spec, 0.5, "ts", "batch", origin, 200)
    drifted = {r.batch: r.epoch for r in out.where("drifted").select("batch", "epoch").distinct().collect()}
    assert drifted == {2: 1}  # batches start at 0, 100, 200, 300 seconds
    literal = d.drift(rows.where("batch = 2"), spec, 0.5, event=1).drop("ts", "batch")
    assert sorted(out.where("drifted").select(*literal.columns).collect()) == sorted(literal.collect())
    kept = out.where("not drifted").select(*literal.columns)
    assert kept.exceptAll(rows.select(*literal.columns)).count() == 0 and kept.count() == 300


def test_share_change_sees_new_and_lost_categories(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("z",), (None,), ("x",)], "c string")
    rows = {r.category: r.share_change for r in d.share_change(a, b, "c").collect()}
    assert rows == {"x": 0.0, "y": -0.5, "z": 0.25, None: 0.25}
