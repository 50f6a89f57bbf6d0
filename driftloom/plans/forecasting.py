"""Queries: forecasts, generated continuations and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import truncated
from driftloom.operators import forecast as f
from driftloom.operators import learned, refit
from driftloom.operators.arima import arima_forecast, fit_arima, fit_groups
from driftloom.operators.arima import forecast_arima as forecast_from
from driftloom.operators.series import SeriesKey
from driftloom.plans import duck
from driftloom.plans.tables import query, table
from driftloom.session import cut_lineage, fresh_path

SEED, DAY, STEPS = 42, 86400, 24
TYPE = SeriesKey(("event_type",), "day")
FLAGS = SeriesKey(("l_returnflag", "l_linestatus"), "day")

DAILY_SQL = """(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 4) AS y
               FROM events GROUP BY 1, 2)"""


def daily_events(spark, folder):
    """Daily totals per event type; rounded, so that both engines start from the same numbers."""
    day = truncated(F.col("ts"), 86400).alias("day")
    events = table(spark, folder, "events")
    return events.groupBy("event_type", day).agg(F.round(F.sum("value"), 4).alias("y"))


def daily_sales(spark, folder):
    """Daily line totals per return flag and line status."""
    day = truncated(F.col("l_shipdate"), 86400).alias("day")
    items = table(spark, folder, "lineitem")
    return items.groupBy("l_returnflag", "l_linestatus", day).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("y"),
        F.avg("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.count("*").alias("lines"),
    )


def fit_sql(source):
    return f"""(WITH a AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY day) AS dy FROM {source}),
        b AS (SELECT *, lag(dy) OVER (PARTITION BY event_type ORDER BY day) AS ldy FROM a),
        c AS (SELECT event_type, count(*) AS n_obs, max(day) AS last_ts, arg_max(y, day) AS y_last,
                arg_max(dy, day) AS dy_last, sum(dy * ldy) AS xy, sum(ldy * ldy) AS xx,
                sum(CASE WHEN ldy IS NOT NULL THEN dy * dy END) AS yy, count(ldy) AS m FROM b GROUP BY 1),
        e AS (SELECT *, greatest(-0.999::DOUBLE, least(0.999::DOUBLE, xy / xx)) AS phi FROM c)
        SELECT event_type, n_obs, last_ts, y_last, dy_last, phi,
            sqrt((yy - 2 * phi * xy + phi * phi * xx) / m) AS sigma, 'ok' AS status FROM e)"""


FORECAST_SQL = f"""(SELECT *, last_ts + to_days(step::INTEGER) AS ts,
        y_last + dy_last * phi * (1 - phi ** step) / (1 - phi) AS forecast
    FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS step FROM {fit_sql(DAILY_SQL)}))"""


def fitted(spark, folder):
    return f.fit_ar(daily_events(spark, folder), TYPE, "y")


@query(
    "forecast_ar",
    f"SELECT event_type, step::INTEGER AS step, ts, {duck.rounded('forecast', 4)} AS forecast, status FROM {FORECAST_SQL}",
)
def forecast_ar(spark, folder):
    out = f.forecast_ar(fitted(spark, folder), STEPS, DAY)
    return out.select("event_type", "step", "ts", F.round("forecast", 4).alias("forecast"), "status")


@query(
    "fit_ar",
    f"""SELECT event_type, n_obs, last_ts, round(phi, 8) AS phi, round(sigma, 4) AS sigma, status
        FROM {fit_sql(DAILY_SQL)}""",
)
def fit_ar(spark, folder):
    out = fitted(spark, folder).withColumns({"phi": F.round("phi", 8), "sigma": F.round("sigma", 4)})
    return out.select("event_type", "n_obs", "last_ts", "phi", "sigma", "status")


@query(
    "forecast_calendar",
    f"""SELECT user_id, step::INTEGER AS step, last_ts + to_hours(step::INTEGER) AS ts
        FROM (SELECT user_id, max(ts) AS last_ts, unnest(range(1, {STEPS + 1})) AS step FROM events GROUP BY 1)""",
)
def forecast_calendar(spark, folder):
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return f.forecast_calendar(last, "last_ts", STEPS, 3600).select("user_id", "step", "ts")


_ID = duck.text_id("event_type")


@query(
    "forecast_noise",
    f"""SELECT event_type, step::INTEGER AS step, ts, round(forecast + 0.1::DOUBLE
            * stddev_pop(forecast) OVER (PARTITION BY event_type)
            * {duck.normal(SEED, 'generated', 'noise', _ID, 'step')}, 4) AS generated
        FROM {FORECAST_SQL}
        UNION ALL
        SELECT event_type, 0, ts, round(forecast + 0.1::DOUBLE * sigma
            * {duck.normal(SEED, 'generated', 'noise', _ID, 'step')}, 4)
        FROM {FORECAST_SQL} WHERE step = 1""",
)
def forecast_noise(spark, folder):
    """Generated continuation of 24 steps, and (as step 0) of a single step."""
    coefficients, sid = fitted(spark, folder), rng.text_id("event_type")
    many = f.with_noise(f.forecast_ar(coefficients, STEPS, DAY), ["event_type"], 0.1, SEED, sid)
    one = f.with_noise(f.forecast_ar(coefficients, 1, DAY), ["event_type"], 0.1, SEED, sid)
    both = many.unionByName(one.withColumn("step", F.lit(0)))
    return both.select("event_type", "step", "ts", F.round("generated", 4).alias("generated"))


@query(
    "seasonal_naive",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k,
                    max(day) OVER (PARTITION BY event_type) AS last_ts FROM {DAILY_SQL})
        SELECT event_type, step::INTEGER AS step, last_ts + to_days(step::INTEGER) AS ts, y AS forecast, 'ok' AS status
        FROM r, (SELECT unnest(range(1, {STEPS + 1})) AS step) WHERE k <= 7 AND (step - 1) % 7 = 7 - k""",
)
def seasonal_naive(spark, folder):
    return f.seasonal_naive(daily_events(spark, folder), TYPE, "y", 7, STEPS, DAY)


@query(
    "moment_sampler",
    f"""SELECT user_id, step::INTEGER AS step, last_ts + to_hours(step::INTEGER) AS ts,
            round(m + coalesce(s, 0) * {duck.normal(SEED, 'generated', 'moments', 'user_id', 'step')}, 6) AS generated,
            {duck.rounded(duck.normal(SEED, 'absent', 'moments', 'user_id', 'step'))} AS absent
        FROM (SELECT user_id, max(ts) AS last_ts, avg(value) AS m, stddev_samp(value) AS s,
                unnest(range(1, {STEPS + 1})) AS step FROM events GROUP BY user_id)""",
)
def moment_sampler(spark, folder):
    events, key = table(spark, folder, "events"), SeriesKey(("user_id",), "ts")
    sid = "user_id"
    out = f.sample_moments(f.fit_moments(events, key, "value"), STEPS, 3600, SEED, sid)
    absent = f.sample_moments(f.fit_moments(events, key, "no_such_column"), STEPS, 3600, SEED, sid, "absent")
    both = out.join(absent.select("user_id", "step", "absent"), ["user_id", "step"])
    return both.select(
        "user_id", "step", "ts", F.round("generated", 6).alias("generated"), F.round("absent", 6).alias("absent")
    )


@query(
    "standardise",
    """SELECT o_orderkey, round((o_totalprice - a) / b, 8) + 0.0::DOUBLE AS o_totalprice,
            round((o_custkey - c) / d, 8) + 0.0::DOUBLE AS o_custkey, 0.0::DOUBLE AS one
        FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b, avg(o_custkey) AS c,
                        stddev_pop(o_custkey) AS d FROM orders)""",
)
def standardise(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey", F.lit(1.0).alias("one"))
    out = f.standardise(orders, ["o_totalprice", "o_custkey", "one"])
    return out.withColumns({c: F.round(c, 8) for c in ("o_totalprice", "o_custkey")})


@query(
    "one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS "o_orderstatus=F",
            (o_orderstatus = 'O')::INTEGER AS "o_orderstatus=O" FROM orders""",
)
def one_hot(spark, folder):
    """Categories F and O; a pending order is unknown and gives zeros."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return f.one_hot(orders, "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


@query(
    "one_hot_rows",
    "SELECT o_orderkey, o_orderpriority AS category FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def one_hot_rows(spark, folder):
    """Sparse encoding with categories from a table; a low priority is no category of it."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    known = f.categories_of(orders.where("o_orderpriority <> '5-LOW'"), "o_orderpriority")
    return f.one_hot_rows(orders, "o_orderpriority", known, "o_orderkey")


@query(
    "model_saved",
    f"SELECT event_type, step::INTEGER AS step, ts, {duck.rounded('forecast', 4)} AS forecast, 2 AS version FROM {FORECAST_SQL}",
)
def model_saved(spark, folder):
    """Two stored versions of a coefficient table (the older one on half the days); newest wins."""
    path, daily = fresh_path(spark, "coefficients"), daily_events(spark, folder)
    early = daily.where(F.col("day") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for version, history in ((1, early), (2, daily)):
        learned.retrain(history, TYPE, lambda window: f.fit_ar(window, TYPE, "y"), path, version)
    coefficients = learned.load_coefficients(spark, path, TYPE.keys)
    out = f.forecast_ar(coefficients, STEPS, DAY)
    return out.select("event_type", "step", "ts", F.round("forecast", 4).alias("forecast"), "version")


@query(
    "refit_sums",
    """WITH s AS (SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate)::TIMESTAMP AS day, round(sum(l_extendedprice), 2) AS y
                  FROM lineitem GROUP BY ALL),
        a AS (SELECT *, y - lag(y) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY day) AS dy FROM s),
        b AS (SELECT *, lag(dy) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY day) AS ldy FROM a),
        c AS (SELECT l_returnflag, l_linestatus, count(*) AS n_obs, max(day) AS last_ts, arg_max(y, day) AS y_last,
                arg_max(dy, day) AS dy_last, count(ldy) AS m, sum(dy * ldy) AS xy, sum(ldy * ldy) AS xx,
                sum(CASE WHEN ldy IS NOT NULL THEN dy * dy END) AS yy FROM b GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, n_obs, last_ts, y_last, round(dy_last, 2) AS dy_last, round(xy / xx, 8) AS phi,
            round(sqrt((yy - 2 * xy / xx * xy + xy / xx * xy) / m), 2) AS sigma FROM c""",
)
def refit_sums(spark, folder):
    """Daily sales come in three batches; each refit reads its batch and the stored sums, and gives the fit of all so far."""
    sales, path = cut_lineage(daily_sales(spark, folder)), fresh_path(spark, "sums")
    edges = [None, "1994-06-30", "1996-11-11", None]
    for version, (low, high) in enumerate(zip(edges, edges[1:]), 1):
        batch = sales.where(F.lit(low is None) | (F.col("day") > F.lit(low or "1970-01-01").cast("timestamp_ntz")))
        batch = batch.where(F.lit(high is None) | (F.col("day") <= F.lit(high or "1970-01-01").cast("timestamp_ntz")))
        stored = refit.update_sums(batch, FLAGS, "y", path, version)
    out = refit.fit_sums(stored, FLAGS.keys)
    return out.select(
        *FLAGS.keys, "n_obs", "last_ts", "y_last", F.round("dy_last", 2).alias("dy_last"), F.round("phi", 8).alias("phi"), F.round("sigma", 2).alias("sigma")
    )


@query("forecast_arima")
def forecast_arima(spark, folder):
    return arima_forecast(daily_sales(spark, folder), FLAGS, "y", STEPS, DAY)


@query("forecast_sarima")
def forecast_sarima(spark, folder):
    return arima_forecast(daily_sales(spark, folder), FLAGS, "y", STEPS, DAY, seasonal=(1, 1, 1, 12))


SALES_SQL = """(SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate)::TIMESTAMP AS day, target, y FROM (
    SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate) AS l_shipdate, round(sum(l_extendedprice), 2) AS y1,
        count(*)::DOUBLE AS y2 FROM lineitem GROUP BY ALL) UNPIVOT (y FOR target IN (y1, y2)))"""


@query(
    "arima_stored",
    f"""WITH a AS (SELECT *, y - lag(y) OVER (PARTITION BY l_returnflag, l_linestatus, target ORDER BY day) AS w FROM {SALES_SQL}),
        b AS (SELECT *, lag(w) OVER (PARTITION BY l_returnflag, l_linestatus, target ORDER BY day) AS x FROM a),
        c AS (SELECT l_returnflag, l_linestatus, target, max(day) AS last_ts, arg_max(y, day) AS yn, arg_max(w, day) AS wn,
                sum(w * x) / sum(x * x) AS phi, count(*) AS n FROM b GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, CASE target WHEN 'y1' THEN 'y' ELSE 'lines' END AS target, n AS n_obs, round(phi, 6) AS phi,
            step::INTEGER AS step, last_ts + to_days(step::INTEGER) AS ts,
            round(yn + wn * phi * (1 - phi ** step) / (1 - phi), 3) AS forecast
        FROM c, (SELECT unnest(range(1, {STEPS + 1})) AS step)""",
)
def arima_stored(spark, folder):
    """ARIMA(1,1,0) of two targets on whole series: fitted, stored, loaded and used for a later horizon."""
    path = fresh_path(spark, "arima")
    sales = daily_sales(spark, folder)
    learned.save_coefficients(fit_arima(sales, FLAGS, ["y", "lines"], (1, 1, 0)), path, 1)
    stored = learned.load_coefficients(spark, path, [*FLAGS.keys, "target"])
    out = forecast_from(stored, STEPS, DAY, (1, 1, 0))
    return out.select(*FLAGS.keys, "target", "n_obs", F.round(F.col("coefficients")[0], 6).alias("phi"), "step", "ts", F.round("forecast", 3).alias("forecast"))


@query(
    "forecast_seasonal_walk",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM {DAILY_SQL}),
        e AS (SELECT event_type, max(day) AS last_ts, list(y ORDER BY k) AS v FROM r WHERE k <= 8 GROUP BY 1)
        SELECT event_type, step::INTEGER AS step, last_ts + to_days(step::INTEGER) AS ts,
            round(v[1] + v[8 - step] - v[8], 4) AS forecast
        FROM e, (SELECT unnest(range(1, 8)) AS step)""",
)
def forecast_seasonal_walk(spark, folder):
    """(0,1,0)(0,1,0,7): the last value plus what last week's values changed since then."""
    out = arima_forecast(daily_events(spark, folder), TYPE, "y", 7, DAY, (0, 1, 0), (0, 1, 0, 7))
    return out.select("event_type", "step", "ts", F.round("forecast", 4).alias("forecast"))


@query(
    "custom_model",
    f"""SELECT event_type, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept
        FROM (SELECT *, epoch_us(day) // 86400000000 - 19700 AS x FROM {DAILY_SQL}) GROUP BY 1""",
)
def custom_model(spark, folder):
    """A line through the daily totals of every type, as a user's own pandas model."""
    import pandas as pd

    def line(pdf):
        x = (pdf["day"].astype("datetime64[us]").astype("int64") // 86_400_000_000 - 19700).astype(float)
        slope = ((x - x.mean()) * (pdf["y"] - pdf["y"].mean())).sum() / ((x - x.mean()) ** 2).sum()
        return pd.DataFrame({"event_type": [pdf["event_type"].iloc[0]], "slope": [slope], "intercept": [pdf["y"].mean() - slope * x.mean()]})

    out = fit_groups(daily_events(spark, folder), TYPE, line, "event_type string, slope double, intercept double", 100_000, cut=False)
    return out.select("event_type", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("forest")
def forest(spark, folder):
    """Forest per target on the daily sales, saved, loaded and applied."""
    sales, path = daily_sales(spark, folder), fresh_path(spark, "forest")
    features = ["quantity", "discount", "lines", "l_returnflag", "l_linestatus"]
    learned.save_models(learned.train_forest(sales, ["y"], features), path)
    out = learned.predict_forest(learned.load_models(["y"], path), sales)
    return out.select("l_returnflag", "l_linestatus", "day", "y", "predicted_y")


@query(
    "forest_groups",
    """SELECT l_returnflag, l_linestatus, day, round(avg(y) OVER (PARTITION BY l_returnflag, l_linestatus), 3) AS predicted_y
       FROM (SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate)::TIMESTAMP AS day, round(sum(l_extendedprice), 2) AS y
             FROM lineitem GROUP BY ALL)""",
)
def forest_groups(spark, folder):
    """One tree without resampling on the two keys: the mean of each group."""
    sales = daily_sales(spark, folder)
    models = learned.train_forest(sales, ["y"], list(FLAGS.keys), trees=1)
    out = learned.predict_forest(models, sales)
    return out.select("l_returnflag", "l_linestatus", "day", F.round("predicted_y", 3).alias("predicted_y"))


_FLAG_ID = duck.text_id("concat(l_returnflag, l_linestatus)")


@query(
    "forest_recursive_groups",
    f"""SELECT l_returnflag, l_linestatus, step::INTEGER AS step, last_ts + to_days(step::INTEGER) AS ts,
            round(m * (1.0::DOUBLE + 0.01::DOUBLE * {duck.normal(SEED, 'y', 'recursive', _FLAG_ID, 'step')}), 3) AS generated
        FROM (SELECT l_returnflag, l_linestatus, max(day) AS last_ts, avg(y) AS m FROM (
                SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate)::TIMESTAMP AS day, round(sum(l_extendedprice), 2) AS y
                FROM lineitem GROUP BY ALL) GROUP BY ALL), (SELECT unnest(range(1, 7)) AS step)""",
)
def forest_recursive_groups(spark, folder):
    """Six days per series from a one-tree model of the keys: the group's mean with keyed noise."""
    sales = daily_sales(spark, folder)
    model = learned.train_forest(sales, ["y"], list(FLAGS.keys), trees=1)["y"]
    state = learned.last_lags(sales, FLAGS, "y", 1)
    sid = rng.text_id("concat(l_returnflag, l_linestatus)")
    out = learned.generate_recursively(model, state, FLAGS.keys, "y", 1, 6, DAY, SEED, sid)
    return out.withColumn("generated", F.round("generated", 3))


@query("forest_recursive")
def forest_recursive(spark, folder):
    """Twelve days per series, each prediction fed back as the newest lag."""
    sales, lags = daily_sales(spark, folder), 3
    frame = learned.lag_frame(sales, FLAGS, "y", lags)
    features = [*FLAGS.keys, *[f"lag_{i}" for i in range(1, lags + 1)]]
    model = learned.train_forest(frame, ["y"], features, trees=20)["y"]
    state = learned.last_lags(sales, FLAGS, "y", lags)
    sid = rng.text_id("concat(l_returnflag, l_linestatus)")
    return learned.generate_recursively(model, state, FLAGS.keys, "y", lags, 12, DAY, SEED, sid)
