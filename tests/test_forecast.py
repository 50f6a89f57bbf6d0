from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.operators import fallback as fb
from driftloom.operators import forecast as f
from driftloom.operators import learned
from driftloom.operators.arima import Shape, arima_forecast, fit_arima, fit_groups
from driftloom.operators.series import SeriesKey
from driftloom.session import fresh_path

START, KEY = datetime(2024, 1, 1), SeriesKey(("k",), "ts")


def series(spark, **values):
    rows = [(k, START + timedelta(hours=i), None if v is None else float(v)) for k, y in values.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")


def simulated(phi, theta, n=1000, seed=0):
    e = np.random.default_rng(seed).normal(size=n + 100)
    w = np.zeros(n + 100)
    for t in range(1, n + 100):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(w[100:])


def test_ar_recovers_phi_and_forecast_decays(spark):
    df = series(spark, a=simulated(0.7, 0.0), flat=[5.0] * 20, short=[1.0, 2.0])
    fits = {r.k: r for r in f.fit_ar(df, KEY, "y").collect()}
    assert abs(fits["a"].phi - 0.7) < 0.06 and abs(fits["a"].sigma - 1) < 0.1
    assert (fits["a"].status, fits["flat"].status, fits["short"].status) == ("ok", "constant", "short")
    out = f.forecast_ar(f.fit_ar(df, KEY, "y"), 24).toPandas()
    assert (out[out.k == "flat"].forecast == 5.0).all() and out.groupby("k").size().eq(24).all()
    steps = out[out.k == "a"].sort_values("step").forecast.diff().dropna().to_numpy()
    assert np.allclose(steps[1:] / steps[:-1], fits["a"].phi)


def test_explosive_series_is_bounded(spark):
    assert f.fit_ar(series(spark, a=[2.0**i for i in range(30)]), KEY, "y").first().phi == f.PHI_LIMIT


@pytest.mark.parametrize("phi, theta", [(0.6, 0.3), (-0.6, -0.3), (0.8, -0.3)])
def test_arima_recovers_parameters(spark, phi, theta):
    fit = fit_arima(series(spark, a=simulated(phi, theta, 4000)), KEY, ["y"]).first()
    assert fit.status == "ok" and np.allclose(fit.coefficients, [phi, theta], atol=0.09) and abs(fit.sigma - 1) < 0.05


def test_sarima_recovers_parameters(spark):
    phi, theta, sphi, stheta, s = 0.5, 0.3, 0.6, 0.4, 6
    e = np.random.default_rng(2).normal(size=5000)
    w = np.zeros(5000)
    for t in range(30, 5000):
        w[t] = phi * w[t - 1] + sphi * w[t - s] - phi * sphi * w[t - s - 1]
        w[t] += e[t] + theta * e[t - 1] + stheta * e[t - s] + theta * stheta * e[t - s - 1]
    y, seasonal = np.cumsum(w[500:]), np.zeros(len(w[500:]) + s)
    for t in range(len(y)):
        seasonal[t + s] = seasonal[t] + y[t]
    fit = fit_arima(series(spark, a=seasonal), KEY, ["y"], (1, 1, 1), (1, 1, 1, s)).first()
    want = [phi, sphi, -phi * sphi, theta, stheta, theta * stheta]
    assert fit.status == "ok" and np.allclose(fit.coefficients, want, atol=0.15)


def seasonal_walk(n, s=12, seed=2):
    """ARIMA(1,1,1)(1,1,1,s) of ``n`` values, and its coefficients by lag."""
    phi, theta, sphi, stheta = 0.5, 0.3, 0.6, 0.4
    e = np.random.default_rng(seed).normal(size=n + 500)
    w = np.zeros(n + 500)
    for t in range(s + 1, n + 500):
        w[t] = phi * w[t - 1] + sphi * w[t - s] - phi * sphi * w[t - s - 1]
        w[t] += e[t] + theta * e[t - 1] + stheta * e[t - s] + theta * stheta * e[t - s - 1]
    y, seasonal = np.cumsum(w[500:]), np.zeros(n + s)
    for t in range(n):
        seasonal[t + s] = seasonal[t] + y[t]
    return seasonal, [phi, sphi, -phi * sphi, theta, stheta, theta * stheta]


def test_sarima_recovers_parameters_at_the_period_of_the_query(spark):
    many = {str(seed): seasonal_walk(6000, seed=seed)[0] for seed in range(4)}
    fits = fit_arima(series(spark, **many), KEY, ["y"], (1, 1, 1), (1, 1, 1, 12)).collect()
    assert {r.status for r in fits} == {"ok"} and len(fits) == 4
    off = np.array([r.coefficients for r in fits]) - seasonal_walk(1)[1]
    print("largest errors, of one series and of the mean:", np.abs(off).max(), np.abs(off.mean(0)).max())
    assert np.abs(off).max() < 0.1 and np.abs(off.mean(0)).max() < 0.05


def test_short_series_are_fitted(spark):
    """From ten observations on, also beside a long series."""
    many = {f"n{n}": simulated(0.7, 0.3, n, seed=n) for n in (9, 10, 12, 30, 47, 2000)}
    out = arima_forecast(series(spark, **many), KEY, "y", 3, 3600).toPandas()
    by = {k: g for k, g in out.groupby("k")}
    assert {k for k, g in by.items() if set(g.status) == {"short"}} == {"n9"}
    for n in (10, 12, 30, 47, 2000):
        got = by[f"n{n}"]
        assert set(got.status) == {"ok"} and got.sigma.iloc[0] > 0 and np.any(got.coefficients.iloc[0]) and got.forecast.nunique() > 1
    alone = arima_forecast(series(spark, n30=many["n30"]), KEY, "y", 3, 3600).toPandas()
    assert np.allclose(sorted(alone.forecast), sorted(by["n30"].forecast), atol=1e-8)


def test_arima_edge_cases(spark):
    values = {"none": [None, None], "one": [3.0], "flat": [7.0] * 60, "mean": np.random.default_rng(1).normal(5, 1, 500)}
    for order in ((1, 1, 1), (1, 0, 0)):
        out = arima_forecast(series(spark, **values), KEY, "y", 2, 3600, order).toPandas()
        assert out.groupby("k").size().eq(2).all() and len(out) == 8
        by = {k: g for k, g in out.groupby("k")}
        assert set(by["none"].status) == {"empty"} and by["none"].forecast.isna().all()
        assert by["one"].forecast.tolist() == [3.0, 3.0] and set(by["one"].status) == {"short"}
        assert by["flat"].forecast.tolist() == [7.0, 7.0]
    assert abs(by["mean"].coefficients.iloc[0][-1] - 5) < 0.2 and (by["mean"].forecast - 5).abs().max() < 1


def test_arima_does_not_depend_on_chunks(spark):
    df = series(spark, a=simulated(0.6, 0.3, 400), b=simulated(0.2, 0.1, 90, seed=3))
    whole = {(r.k, r.step): r.forecast for r in arima_forecast(df, KEY, "y", 3, 3600).collect()}
    cut = {(r.k, r.step): r.forecast for r in arima_forecast(df, SeriesKey(("k",), "ts", chunk_rows=50), "y", 3, 3600).collect()}
    assert whole.keys() == cut.keys() and all(abs(whole[x] - cut[x]) < 1e-8 for x in whole)


def test_arima_job(spark):
    gaps = [None if i % 9 == 4 else v for i, v in enumerate(simulated(0.6, 0.3, 300))]
    out = arima_forecast(series(spark, a=gaps, b=simulated(0.2, 0.1, 300), c=[1.0]), KEY, "y", 5, 3600).toPandas()
    assert out.groupby("k").size().to_dict() == {"a": 5, "b": 5, "c": 5}
    assert set(out[out.k != "c"].status) == {"ok"} and set(out[out.k == "c"].status) == {"short"}
    assert out[out.k == "a"].ts.min() == START + timedelta(hours=300)


def css(y, order, seasonal, parameters):
    """Innovations of plain loops over a series, for parameters (phi, seasonal phi, theta, seasonal theta)."""
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    w = np.diff(np.asarray(y, float), d) if d else np.asarray(y, float)
    for _ in range(sd):
        w = w[s:] - w[:-s]
    phi, sphi, theta, stheta = np.split(np.asarray(parameters, float), np.cumsum([p, sp, q])[:3])
    one, two = np.r_[1, -phi], np.zeros(s * sp + 1)
    two[0] = 1
    if sp:
        two[s::s] = -sphi
    ar = np.convolve(one, two)
    one, two = np.r_[1, theta], np.zeros(s * sq + 1)
    two[0] = 1
    if sq:
        two[s::s] = stheta
    ma = np.convolve(one, two)
    e = np.zeros(len(w))
    for t in range(len(ar) - 1, len(w)):
        e[t] = sum(c * w[t - i] for i, c in enumerate(ar)) - sum(c * e[t - i] for i, c in enumerate(ma) if 0 < i <= t)
    return e, len(ar) - 1


@pytest.mark.parametrize(("order", "seasonal", "chunk_rows"), [
    ((1, 1, 1), (0, 0, 0, 0), 1_000_000), ((2, 0, 1), (0, 0, 0, 0), 1_000_000), ((1, 1, 1), (1, 1, 1, 4), 1_000_000), ((0, 1, 2), (0, 0, 0, 0), 1_000_000),
    ((2, 1, 0), (0, 0, 0, 0), 1_000_000), ((1, 1, 1), (1, 1, 1, 4), 60), ((2, 0, 1), (0, 0, 0, 0), 60),
])
def test_arima_is_the_least_of_the_sum_of_squares(spark, order, seasonal, chunk_rows):
    """Against plain loops: the residuals are the innovations, and no small step finds a smaller sum."""
    y = simulated(0.5, 0.4, 240, seed=5) if order[1] else simulated(0.5, 0.4, 240, seed=5)[1:] - simulated(0.5, 0.4, 240, seed=5)[:-1] + 3
    got = fit_arima(series(spark, a=y), SeriesKey(("k",), "ts", chunk_rows=chunk_rows), ["y"], order, seasonal).first()
    assert got.status == "ok"
    shape = Shape(order, seasonal)
    beta = np.array(got.coefficients)[: len(shape.ar) + len(shape.ma)]
    best = shape.parameters(beta[: len(shape.ar)], beta[len(shape.ar) :])
    level = y if order[1] else np.asarray(y) - np.mean(y)
    e, skipped = css(level, order, seasonal, best)
    assert got.sigma == pytest.approx(np.sqrt(e @ e / (len(e) - skipped)), rel=1e-9)
    held = min(len(got.last_e), max([1, *shape.ma]))
    assert np.allclose(got.last_e[-held:], e[-held:], atol=1e-8)
    for i in range(len(best)):
        for by in (-1e-3, 1e-3):
            near = best + by * np.eye(len(best))[i]
            other, _ = css(level, order, seasonal, near)
            assert other @ other >= e @ e * (1 - 1e-9)


def test_null_key_and_ties_of_arima(spark):
    """A null key is a series of its own, on both ways; large integer keys keep their value."""
    y = simulated(0.5, 0.3, 80)
    rows = [(k, START + timedelta(hours=i), float(v)) for k in (None, (1 << 60) + 1) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, y double")
    for chunk_rows in (1_000_000, 25):
        out = arima_forecast(df, SeriesKey(("k",), "ts", chunk_rows=chunk_rows), "y", 3, 3600).collect()
        assert sorted((str(r.k), r.step) for r in out) == [(k, s) for k in sorted([str((1 << 60) + 1), "None"]) for s in (1, 2, 3)]
        assert {r.status for r in out} == {"ok"} and len({round(r.forecast, 9) for r in out}) == 3


def test_custom_model_fails_on_a_longer_series(spark):
    with pytest.raises(Exception, match="max_rows"):
        fit_groups(series(spark, a=range(10)), KEY, lambda pdf: pdf, "k string, ts timestamp_ntz, y double", 5, cut=False).collect()


def test_custom_model(spark):
    def mean_model(pdf):
        return pd.DataFrame({"k": [pdf.k.iloc[0]], "mean": [pdf.y.mean()]})

    out = fit_groups(series(spark, a=range(100), b=[1.0]), KEY, mean_model, "k string, mean double", 10)
    assert {r.k: r.mean for r in out.collect()} == {"a": 94.5, "b": 1.0}


def test_seasonal_naive_repeats_and_needs_a_season(spark):
    out = f.seasonal_naive(series(spark, a=range(10), b=[1, 2]), KEY, "y", 3, 7, 3600)
    rows = out.where("k = 'a'").orderBy("step").collect()
    assert [r.forecast for r in rows] == [7, 8, 9, 7, 8, 9, 7]
    assert rows[0].ts == START + timedelta(hours=10)
    assert [(r.forecast, r.status) for r in out.where("k = 'b'").collect()] == [(2, "short")] * 7


def test_fits_use_the_whole_series(spark):
    """Three thousand points, the first half with another coefficient than the second."""
    y = np.concatenate([simulated(0.8, 0.0, 1500), simulated(-0.5, 0.0, 1500, seed=1)])
    fit = f.fit_ar(series(spark, a=y), KEY, "y").first()
    d = np.diff(y)
    assert fit.n_obs == 3000 and abs(fit.phi - (d[1:] @ d[:-1]) / (d[:-1] @ d[:-1])) < 1e-9


def test_noise_scale(spark):
    df = series(spark, a=simulated(0.9, 0.0))
    many = f.with_noise(f.forecast_ar(f.fit_ar(df, KEY, "y"), 2000), ["k"], 0.5, 1, "0").toPandas()
    spread = (many.generated - many.forecast).std() / many.forecast.std(ddof=0)
    assert abs(spread - 0.5) < 0.05
    one = f.with_noise(f.forecast_ar(f.fit_ar(df, KEY, "y"), 1), ["k"], 0.5, 1, "0").first()
    assert one.generated != one.forecast


def test_standardise_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, 3.0, "a"), (2.0, 3.0, "b"), (3.0, 3.0, None)], "x double, c double, t string")
    known = f.categories_of(df, "t")
    assert {(r.x, r.category) for r in f.one_hot_rows(df, "t", known, "x").collect()} == {(1.0, "a"), (2.0, "b")}
    out = f.one_hot(f.standardise(df, ["x", "c"]), "t", ["a", "b"]).orderBy("x").toPandas()
    assert np.allclose(out.x, [-1.224744871, 0, 1.224744871]) and (out.c == 0).all()
    assert out["t=a"].tolist() == [1, 0, 0] and out["t=b"].tolist() == [0, 1, 0]


def test_forest_predicts_in_target_units_and_reloads(spark):
    r = np.random.default_rng(4)
    x = r.random(400)
    rows = [(float(v), "u" if v > 0.5 else "d", 1000 + 100 * float(v), float(-v)) for v in x]
    df = spark.createDataFrame(rows, "x double, side string, y double, z double")
    models = learned.train_forest(df, ["y", "z"], ["x", "side"], trees=10)
    path = fresh_path(spark, "models")
    learned.save_models(models, path)
    unseen = spark.createDataFrame([(0.9, "sideways", 0.0, 0.0)], df.schema)
    for frame in (df, unseen):
        a = learned.predict_forest(models, frame).toPandas()
        b = learned.predict_forest(learned.load_models(["y", "z"], path), frame).toPandas()
        pd.testing.assert_frame_equal(a, b)
    fitted = learned.predict_forest(models, df).toPandas()
    assert (fitted.predicted_y - fitted.y).abs().mean() < 10 and fitted.predicted_z.between(-1, 0).all()
    assert learned.default_features(df, ["y", "z"]) == ["x"]
    gaps = spark.createDataFrame([(None, "u", 0.0, 0.0), (0.2, None, 0.0, 0.0)], df.schema)
    assert learned.predict_forest(models, gaps).where("predicted_y is not null").count() == 2


def test_compiled_forest_equals_the_model_and_a_walk_over_its_saved_nodes(spark):
    """The expression gives what the ML pipeline gives, and what DuckDB finds walking the saved nodes."""
    import duckdb

    r = np.random.default_rng(11)
    side = ["u", "d", "it's", "back\\slash"]
    rows = [(int(i), float(v), int(50 * w), side[int(4 * q)], float(100 * v + 30 * (q > 0.5) + w)) for i, (v, w, q) in enumerate(r.random((500, 3)))]
    rows += [(1000, None, 3, "u", 1.0), (1001, float("nan"), None, None, 2.0), (1002, 1e300, -7, "never seen", 3.0), (1003, -0.0, 0, "", 4.0)]
    df = spark.createDataFrame(rows, "id long, x double, n int, side string, y double")
    train = df.where("id < 1000").withColumn("flat", F.lit(2.0))
    models = learned.train_forest(train, ["y"], ["x", "n", "flat", "side"], trees=100)
    df = df.withColumn("flat", F.lit(2.0))
    trees = {t: learned.compiled(m) for t, m in models.items()}
    wanted = learned.predict_forest(models, df).toPandas()
    got = learned.predict_compiled(trees, df)
    pd.testing.assert_frame_equal(got.orderBy("id").toPandas(), wanted.sort_values("id", ignore_index=True))

    nodes, form = learned.forest_nodes(models["y"]).toPandas(), trees["y"]
    frame, features = wanted.set_index("id"), []
    for c, missing, mean, factor in form.numbers:
        features.append((frame[c].astype(float).fillna(missing) - mean) * factor)
    features += [(frame["side"] == label).astype(float) for label in form.labels["side"]]
    inputs = pd.concat([pd.DataFrame({"id": s.index, "feature": i, "v": s.to_numpy()}) for i, s in enumerate(features)])
    walked = duckdb.sql(
        """WITH RECURSIVE walk AS (
               SELECT DISTINCT inputs.id AS row, tree, 0 AS at FROM inputs, (SELECT DISTINCT tree FROM nodes)
               UNION ALL
               SELECT row, w.tree, CASE WHEN (n.categorical AND list_contains(n.bound, i.v)) OR (NOT n.categorical AND i.v <= n.bound[1])
                                        THEN n.low ELSE n.high END
               FROM walk w JOIN nodes n ON n.tree = w.tree AND n.id = w.at AND n.low >= 0 JOIN inputs i ON i.id = w.row AND i.feature = n.feature)
           SELECT row, avg(n.prediction) AS y, count(*) AS trees FROM walk w JOIN nodes n ON n.tree = w.tree AND n.id = w.at AND n.low < 0
           GROUP BY row ORDER BY row"""
    ).df()
    assert (walked.trees == 100).all() and walked.row.tolist() == sorted(frame.index)
    assert np.allclose(walked.y, frame.sort_index().predicted_y, rtol=1e-12)
    # One plan without Python, ML functions or shuffles.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan and "Exchange" not in plan


def test_recursion_equals_steps_of_the_model(spark):
    """The fold over steps equals predicting, shifting the lags and predicting again; a null key and missing lags included."""
    r = np.random.default_rng(3)
    df = series(spark, a=[float(v) for v in r.random(80)], b=[float(5 + v) for v in r.random(60)]).unionByName(
        series(spark, z=[1.0, 2.0]).withColumn("k", F.lit(None).cast("string"))
    )
    models = learned.train_forest(learned.lag_frame(df, KEY, "y", 3), ["y"], ["lag_1", "lag_2", "lag_3", "k"], trees=12)
    state = learned.last_lags(df, KEY, "y", 3)
    out = learned.generate_recursively(models["y"], state, ["k"], "y", 3, 6, 3600, 9, "7").toPandas()
    current = state
    for step in range(1, 7):
        scored = learned.predict_forest(models, current).withColumn("new", F.expr(f"predicted_y * (1.0D + 0.01D * {rng.normal_sql(9, 'y', 'recursive', '7', step)})"))
        wanted = {row.k: row.new for row in scored.collect()}
        got = dict(zip(out[out.step == step].k.where(out.k.notna(), None), out[out.step == step].generated))
        assert len(got) == 3 and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in wanted.items())
        current = scored.select("k", "last_ts", F.col("new").alias("lag_1"), F.col("lag_1").alias("lag_2"), F.col("lag_2").alias("lag_3"))


def test_recursion_feeds_predictions_back(spark):
    df = series(spark, a=[i % 2 for i in range(60)], b=[(i + 1) % 2 for i in range(60)])
    frame = learned.lag_frame(df, KEY, "y", 2)
    model = learned.train_forest(frame, ["y"], ["lag_1", "lag_2"], trees=5)["y"]
    state = learned.last_lags(df, KEY, "y", 2)
    out = learned.generate_recursively(model, state, ["k"], "y", 2, 5, 3600, 1, "0", noise_level=0.0)
    rows = out.orderBy("k", "step").toPandas()
    assert rows[rows.k == "a"].generated.round().tolist() == [0, 1, 0, 1, 0]
    assert rows[rows.k == "b"].generated.round().tolist() == [1, 0, 1, 0, 1]
    assert rows.ts.max() == START + timedelta(hours=64)


def test_newest_coefficients_win(spark):
    path = fresh_path(spark, "coefficients")
    df = series(spark, a=range(20), b=range(0, 40, 2))
    learned.retrain(df, KEY, lambda w: f.fit_ar(w, KEY, "y"), path, 1)
    learned.retrain(df.where("k = 'a'"), KEY, lambda w: f.fit_ar(w, KEY, "y"), path, 2, rows=5)
    rows = {r.k: (r.version, r.n_obs) for r in learned.load_coefficients(spark, path, ["k"]).collect()}
    assert rows == {"a": (2, 5), "b": (1, 20)}


# --- fallback ----------------------------------------------------------------


def test_fill_order_and_provenance(spark):
    real = spark.createDataFrame(
        [("a", START, 1.0, None), ("a", START + timedelta(hours=1), None, "rate_limited"), ("b", START, None, "error")],
        "k string, bucket timestamp_ntz, v double, why string",
    )
    names = spark.createDataFrame([("a", 7.0), ("b", None)], "k string, model double")
    grid = fb.time_grid(names, ["k", "model"], F.lit(START), F.lit(START + timedelta(hours=2)), 3600)
    assert grid.count() == 6

    def run(carry):
        rows = fb.fill(grid, real, ["k"], "bucket", "v", F.col("model"), "why", carry=carry).orderBy("k", "bucket")
        return [(r.k, r.v, r.data_type, r.reason) for r in rows.collect()]

    assert run(False) == [
        ("a", 1.0, "real", None), ("a", 7.0, "synthetic", "rate_limited"), ("a", 7.0, "synthetic", "missing"),
        ("b", None, "empty", "error"), ("b", None, "empty", "missing"), ("b", None, "empty", "missing"),
    ]
    assert [r[1] for r in run(True)] == [1.0, 1.0, 1.0, None, None, None]


def test_model_repair_keeps_rows_and_null_keys(spark):
    """A repeated time stays as often as it came, and a null key has its own model."""
    from driftloom.operators.fallback import fill, fill_from_model

    rows = [(k, START + timedelta(hours=i), None if i % 4 == 3 else float(i * i)) for k in ("a", None) for i in range(9)] + [("a", START + timedelta(hours=4), 20.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")
    coefficients = spark.createDataFrame([("a", 0.5), (None, 0.25)], "k string, phi double")
    for chunk_rows in (1_000_000, 4):
        got = fill_from_model(df, SeriesKey(("k",), "ts", ("y",), chunk_rows=chunk_rows), "y", coefficients, F.col("ts")).collect()
        assert len(got) == len(rows) and {r.source for r in got} == {"real", "model"}
        made = {(r.k, r.ts.hour): r.y for r in got if r.source == "model"}
        assert made[(None, 3)] == pytest.approx(4 + 3 * 0.25) and made[("a", 3)] == pytest.approx(4 + 3 * 0.5)
        assert made[("a", 7)] == pytest.approx(36 + 11 * 0.5)
    grid = spark.createDataFrame([("a", 1), (None, 1)], "k string, b int")
    real = spark.createDataFrame([(None, 1, 5.0)], "k string, b int, y double")
    filled = {r.k: (r.y, r.data_type) for r in fill(grid, real, ["k"], "b", "y", F.lit(1.0)).collect()}
    assert filled == {"a": (1.0, "synthetic"), None: (5.0, "real")}


def test_ratio_warns_only_after_enough_batches(spark):
    def rows(k, real, synthetic):
        kinds = ["real"] * real + ["synthetic"] * synthetic
        return [(k, START + timedelta(hours=i), kind) for i, kind in enumerate(kinds)]

    data = rows("few", 0, 10) + rows("many", 2, 9) + rows("fine", 5, 6)
    df = spark.createDataFrame(data, "k string, bucket timestamp_ntz, data_type string")
    got = {r.k: r.warning for r in fb.synthetic_ratio(df, ["k"], "bucket").collect()}
    assert got == {"few": False, "many": True, "fine": False}


# --- additive refits -------------------------------------------------------------


@pytest.mark.parametrize("p", [1, 3])
def test_sums_of_batches_equal_those_of_the_whole(spark, p):
    """Any cut into batches, some of one value, gives the windows and products of the whole series."""
    from driftloom.operators import refit

    r = np.random.default_rng(p)
    values = {"a": r.normal(size=90).round(3), "b": r.normal(size=7).round(3), "c": [4.0], None: r.normal(size=40).round(3)}
    df = series(spark, **{str(k): v for k, v in values.items()}).withColumn("k", F.when(F.col("k") != "None", F.col("k")))
    df = df.unionByName(df.limit(3).withColumns({"y": F.lit(None).cast("double"), "ts": F.lit(START).cast("timestamp_ntz") + F.expr("interval 30 minutes")}))
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts)")
    path = fresh_path(spark, "sums")
    for version, (low, high) in enumerate([(0, 1), (1, 2), (2, 4), (4, 9), (9, 60), (60, 61), (61, 100)], 1):
        batch = df.where((hour >= low) & (hour < high))
        got = refit.update_sums(batch, KEY, "y", path, version, p)
    got = refit.update_sums(batch, KEY, "y", path, version, p)  # a repeated run replaces its version
    whole = refit.lagged_sums(df, SeriesKey(("k",), "ts", chunk_rows=16), "y", p)
    a, b = (x.toPandas().sort_values("n_obs", ignore_index=True) for x in (got, whole))
    for i, (k, y) in enumerate(sorted(values.items(), key=lambda kv: len(kv[1]))):
        d = np.diff(np.asarray(y))
        m = np.array([d[t - p : t + 1][::-1] for t in range(p, len(d))]).reshape(-1, p + 1)
        wanted = [(m[:, i] * m[:, j]).sum() for i in range(p + 1) for j in range(i, p + 1)]
        for frame in (a, b):
            row = frame.loc[i]
            assert (row.k if isinstance(row.k, str) else None) == k and (row.n_obs, row.windows) == (len(y), len(m))
            assert np.allclose(row.sums, wanted) and list(row["tail"]) == list(y[-p - 1 :]) and list(row["head"]) == list(y[: p + 1])
    if p == 1:
        left, right = refit.fit_sums(got, ["k"]).toPandas(), f.fit_ar(df, KEY, "y").toPandas()
        columns = list(right.columns)
        pd.testing.assert_frame_equal(left[columns].sort_values("n_obs", ignore_index=True), right.sort_values("n_obs", ignore_index=True), check_dtype=False)
    else:
        fitted = refit.fit_orders(got, ["k"], p).where("k = 'a'").first()
        d = np.diff(values["a"])
        m = np.array([d[t - p : t + 1][::-1] for t in range(p, len(d))])
        phi = np.linalg.lstsq(m[:, 1:], m[:, 0], rcond=None)[0]
        assert np.allclose(fitted.phi, phi) and fitted.sigma == pytest.approx(np.sqrt(((m[:, 0] - m[:, 1:] @ phi) ** 2).mean()))


def test_overlapping_batches_fail_and_empty_ones_add_nothing(spark):
    from driftloom.operators import refit

    df = series(spark, a=range(10))
    path = fresh_path(spark, "sums")
    refit.update_sums(df, KEY, "y", path, 1)
    assert refit.update_sums(df.limit(0), KEY, "y", path, 2).collect() == refit.lagged_sums(df, KEY, "y").collect()
    with pytest.raises(Exception, match="overlap in time"):
        refit.update_sums(df, KEY, "y", path, 3)
