"""Series operators against pandas, with chunks so small that context crosses many of them."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import series as s

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame():
    """One hot series with a third of the rows, ties in time, gaps, and an all-null series."""
    r = np.random.default_rng(5)
    rows, rid = [], 0
    for series, n in (("hot", 400), ("a", 300), ("b", 299), ("one", 1), ("none", 30)):
        seconds = np.sort(r.integers(0, 40_000, n))
        seconds[: n // 2] = np.sort(r.integers(0, 500, n // 2))  # a busy beginning
        for x in seconds:
            value = None if series == "none" or r.random() < 0.4 else float(np.round(r.normal(), 3))
            rows.append((rid, series, START + timedelta(seconds=int(x)), value))
            rid += 1
    return pd.DataFrame(rows, columns=["id", "series", "ts", "value"]).sample(frac=1, random_state=1)


KEYS = [
    s.SeriesKey(("series",), "ts", ("id",)),
    s.SeriesKey(("series",), "ts", ("id",), chunk_rows=20),
    s.SeriesKey(("series",), "ts", ("id",), chunk_seconds=60.0),
]


@pytest.fixture(scope="module")
def df(spark, frame):
    records = [
        (int(i), k, t.to_pydatetime(), None if pd.isna(v) else float(v))
        for i, k, t, v in frame.itertuples(index=False)
    ]
    return spark.createDataFrame(records, "id bigint, series string, ts timestamp_ntz, value double").repartition(5)


def expected(frame, fn):
    ordered = frame.sort_values(["series", "ts", "id"])
    out = pd.concat([fn(g).rename("x").to_frame().assign(id=g.id) for _, g in ordered.groupby("series")])
    return out.set_index("id").x.sort_index()


def same(df, column, want):
    got = df.select("id", column).toPandas().set_index("id")[column].astype(float).sort_index()
    assert len(got) == len(want)
    pd.testing.assert_series_equal(got, want.astype(float), check_names=False, rtol=1e-9)


@pytest.mark.parametrize("key", KEYS)
def test_interpolate(df, frame, key):
    want = expected(frame, lambda g: g.value.reset_index(drop=True).interpolate("linear").set_axis(g.index))
    same(s.interpolate(df, key, "value", "y"), "y", want)


@pytest.mark.parametrize("key", KEYS)
def test_carry_forward(df, frame, key):
    same(s.carry_forward(df, key, "value", "y"), "y", expected(frame, lambda g: g.value.ffill()))


@pytest.mark.parametrize("key", KEYS)
def test_position(df, frame, key):
    want = expected(frame, lambda g: pd.Series(range(1, len(g) + 1), index=g.index))
    same(s.position(df, key, "y"), "y", want)


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("k", [1, 7])
def test_lag(df, frame, key, k):
    same(s.lag(df, key, "value", k, "y"), "y", expected(frame, lambda g: g.value.shift(k)))


def test_hot_series_is_cut(df):
    sizes = s.chunked(df, KEYS[1]).groupBy("series", "_chunk").count().toPandas()
    assert sizes[sizes.series == "hot"].shape[0] > 20
    assert sizes[sizes.series == "one"]["count"].tolist() == [1]


def test_chunks_follow_time(df):
    rows = s.chunked(df, KEYS[1]).where("series = 'hot'").toPandas().sort_values(["ts", "id"])
    assert rows._chunk.is_monotonic_increasing


@pytest.mark.parametrize("shape", ["stray date", "burst", "null key"])
def test_chunks_are_bounded(spark, shape):
    rows = [(i, "a" if shape != "null key" else None, START + timedelta(seconds=0 if shape == "burst" else i), 1.0) for i in range(20_000)]
    rows.append((-1, rows[0][1], datetime(1970, 1, 1) if shape == "stray date" else START, 1.0))
    df = spark.createDataFrame(rows, "id bigint, series string, ts timestamp_ntz, value double")
    sizes = s.chunked(df, s.SeriesKey(("series",), "ts", (), chunk_rows=1000)).groupBy("series", "_chunk").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 4000 and sizes.agg({"count": "sum"}).first()[0] == 20_001


def test_chunks_are_shared(df):
    key = KEYS[1]
    once = s.chunked(df, key)
    assert s.chunked(once, key) is once
    out = s.carry_forward(s.position(once, key), key, "value", "y")
    assert out.count() == df.count()


def test_null_and_early_times_come_first(spark):
    rows = [(1, "a", datetime(1969, 1, 1), 1.0), (2, "a", None, 2.0), (3, "a", datetime(1980, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "id bigint, series string, ts timestamp_ntz, value double")
    for key in (s.SeriesKey(("series",), "ts", ("id",), chunk_seconds=60.0), s.SeriesKey(("series",), "ts", ("id",), chunk_rows=1)):
        assert {r.id: r.position for r in s.position(df, key).collect()} == {2: 1, 1: 2, 3: 3}


def test_budget_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a", START), (1, "a", START)], "id bigint, series string, ts timestamp_ntz")
    assert {r.data_type for r in s.budget_split(df, s.SeriesKey(("series",), "ts"), "id", 5).collect()} == {"real"}


def test_series_without_keys(df, frame):
    key = s.SeriesKey((), "ts", ("id",), chunk_rows=50)
    ordered = frame.sort_values(["ts", "id"])
    want = pd.Series(ordered.value.ffill().to_numpy(), index=ordered.id).sort_index()
    same(s.carry_forward(df, key, "value", "y"), "y", want)


@pytest.mark.parametrize("key", KEYS)
def test_null_key_is_a_series(spark, key):
    rows = [(1, None, START, 1.0), (2, None, START + timedelta(hours=9), None), (3, "a", START, None)]
    df = spark.createDataFrame(rows, "id bigint, series string, ts timestamp_ntz, value double")
    got = {r.id: (r.y, r.position) for r in s.position(s.carry_forward(df, key, "value", "y"), key).collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 2), 3: (None, 1)}


@pytest.mark.parametrize("oldest", [False, True])
def test_newest(df, frame, oldest):
    ordered = frame.sort_values(["ts", "id"], ascending=oldest)
    want = {k: g.id.tolist() for k, g in ordered.groupby("series").head(25).groupby("series")}
    got = s.newest(df, KEYS[0], 25, rank="r", oldest=oldest, slices=3).toPandas().sort_values("r")
    assert {k: g.id.tolist() for k, g in got.groupby("series")} == want


def test_budget_split(df, frame):
    window = frame.ts.astype("int64") // 10**9 // 60
    first = frame.sort_values(["ts", "id"]).groupby(["series", window]).head(5).id
    got = s.budget_split(df, KEYS[0], "id", 5, 60.0).toPandas()
    assert len(got) == len(frame)
    assert set(got[got.data_type == "real"].id) == set(first)
    assert set(got[got.data_type == "synthetic"].reason) == {"rate_limited"}


def test_deduplicated_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", START, 1.0, 1), ("b", START, 2.0, 1)], "k string, ts timestamp_ntz, v double, n int")
    new = spark.createDataFrame([("a", START, 9.0, 2, "x")], "k string, ts timestamp_ntz, v double, n int, extra string")
    out = s.deduplicated(s.append_history(old, new), s.SeriesKey(("k",), "ts"), "n")
    assert {r.k: (r.v, r.extra) for r in out.collect()} == {"a": (9.0, "x"), "b": (2.0, None)}


def test_empty_input(spark, df):
    none = df.where("false")
    for out in (
        s.interpolate(none, KEYS[0], "value"), s.carry_forward(none, KEYS[0], "value"), s.lag(none, KEYS[0], "value"),
        s.newest(none, KEYS[0], 3), s.budget_split(none, KEYS[0], "id"),
    ):
        assert out.count() == 0


def test_ohlcv(df, frame):
    key = s.SeriesKey(("series",), "ts", ("id",))
    out = s.ohlcv(df.where("value is not null"), key, "value", F.lit(1), F.date_trunc("hour", "ts")).toPandas()
    known = frame.dropna().sort_values(["ts", "id"])
    groups = known.groupby(["series", known.ts.dt.floor("h")]).value
    assert len(out) == len(groups)
    got = out.set_index(["series", "bucket"]).sort_index()
    assert np.allclose(got.open, groups.first()) and np.allclose(got.close, groups.last())
    assert np.allclose(got.high, groups.max()) and (got.volume == groups.size()).all()
