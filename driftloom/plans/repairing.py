"""Queries: order-dependent operations on series."""

from __future__ import annotations

from pyspark.sql import functions as F


from driftloom.functions.scalars import truncated
from driftloom.operators import series as s
from driftloom.plans import duck
from driftloom.plans.tables import query, table

SEED, SHARE = 42, 0.3
KEY = s.SeriesKey(("user_id",), "ts", ("event_id",))
GONE = f"{duck.uniform(SEED, 'value', 'outage', 'event_id')} < {SHARE}::DOUBLE"
# Events with about three in ten readings lost.
LOSSY = f"(SELECT event_id, user_id, ts, CASE WHEN {GONE} THEN NULL ELSE value END AS reading FROM events)"


def lossy(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return s.knocked_out(events, "value", SEED, SHARE, "event_id", "reading").drop("value")


@query(
    "interpolate",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {LOSSY}),
        w AS (SELECT *,
            max(CASE WHEN reading IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS pr,
            min(CASE WHEN reading IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr FROM n)
        SELECT w.event_id, w.user_id, w.ts, w.reading,
            round(CASE WHEN w.reading IS NOT NULL THEN w.reading WHEN b.reading IS NULL THEN a.reading
              ELSE a.reading + (b.reading - a.reading) * (w.rn - w.pr)::DOUBLE / (w.nr - w.pr)::DOUBLE END, 6)
              AS reading_interpolated
        FROM w LEFT JOIN n a ON a.user_id = w.user_id AND a.rn = w.pr
               LEFT JOIN n b ON b.user_id = w.user_id AND b.rn = w.nr""",
)
def interpolate(spark, folder):
    out = s.interpolate(lossy(spark, folder), KEY, "reading")
    return out.withColumn("reading_interpolated", F.round("reading_interpolated", 6))


@query(
    "carry_forward",
    f"""SELECT event_id, user_id, ts, reading, last_value(reading IGNORE NULLS) OVER
            (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reading_filled
        FROM {LOSSY}""",
)
def carry_forward(spark, folder):
    return s.carry_forward(lossy(spark, folder), KEY, "reading")


@query(
    "series_position",
    """SELECT event_id, user_id, ts,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events""",
)
def series_position(spark, folder):
    return s.position(table(spark, folder, "events").select("event_id", "user_id", "ts"), KEY)


@query(
    "lag_diff",
    """SELECT event_id, user_id, ts, value, lag(value, 12) OVER w AS value_lag12,
            round(value - lag(value) OVER w, 6) + 0.0::DOUBLE AS value_diff1
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def lag_diff(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    out = s.lags(events, KEY, {"value_lag12": ("value", 12), "_before": ("value", 1)})
    return out.withColumn("value_diff1", F.round(F.col("value") - F.col("_before"), 6)).drop("_before")


@query(
    "tail_n",
    """SELECT event_id, user_id, ts, value,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS recency
        FROM events QUALIFY recency <= 72""",
)
def tail_n(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return s.newest(events, KEY, 72, rank="recency")


@query(
    "budget_split",
    """SELECT event_id, event_type, ts, CASE WHEN r <= 5 THEN 'real' ELSE 'synthetic' END AS data_type,
            CASE WHEN r > 5 THEN 'rate_limited' END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000
                                           ORDER BY ts, event_id) AS r FROM events)""",
)
def budget_split(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    key = s.SeriesKey(("event_type",), "ts", ("event_id",))
    return s.budget_split(events, key, "event_id", 5, 86400.0)


@query(
    "history_union",
    """WITH h AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, NULL::VARCHAR AS priority FROM orders),
        b AS (SELECT o_custkey, o_orderdate, o_orderkey, NULL::DOUBLE AS o_totalprice,
                o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O'),
        u AS (SELECT *, 0 AS batch FROM h UNION ALL SELECT *, 1 AS batch FROM b)
        SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, priority FROM u
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY batch DESC, o_orderkey DESC) = 1""",
)
def history_union(spark, folder):
    orders = table(spark, folder, "orders")
    history = orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", F.lit(0).alias("batch"))
    batch = orders.where("o_orderstatus = 'O'").select(
        "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("priority"), F.lit(1).alias("batch")
    )
    key = s.SeriesKey(("o_custkey",), "o_orderdate")
    merged = s.append_history(history, batch).withColumn("version", F.struct("batch", "o_orderkey"))
    return s.deduplicated(merged, key, "version").drop("batch", "version")


@query(
    "ohlcv",
    """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, arg_min(value, (ts, event_id)) AS open,
            max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
            count(*) AS volume
        FROM events GROUP BY 1, 2""",
)
def ohlcv(spark, folder):
    key = s.SeriesKey(("event_type",), "ts", ("event_id",))
    day = truncated(F.col("ts"), 86400)
    return s.ohlcv(table(spark, folder, "events"), key, "value", F.lit(1), day)


@query("snapshot", "SELECT event_id, ts, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def snapshot(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    return s.snapshot(events, KEY, 100)


@query(
    "series_index",
    """SELECT event_id, make_timestamp(epoch_us(ts)) AS ts_parsed,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events""",
)
def series_index(spark, folder):
    """Times arrive as text, are parsed (bad ones to null) and order the series."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("string").alias("t"))
    parsed = events.withColumn("ts_parsed", F.col("t").try_cast("timestamp_ntz"))
    key = s.SeriesKey(("user_id",), "ts_parsed", ("event_id",))
    return s.position(parsed, key).select("event_id", "ts_parsed", "position")


