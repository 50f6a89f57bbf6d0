"""Queries: real-or-synthetic repair and its monitoring (batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import floor_to, truncated
from driftloom.operators import fallback as fb
from driftloom.operators.forecast import fit_ar
from driftloom.operators.series import SeriesKey
from driftloom.plans import duck
from driftloom.plans.repairing import LOSSY, lossy
from driftloom.plans.tables import query, table

SEED, DAY = 42, 86400
KEY = SeriesKey(("user_id",), "ts", ("event_id",))

_Z = duck.normal(SEED, "reading", "fallback", "user_id", "epoch_us(bucket) // 86400000000")
FILLED_SQL = f"""(WITH l AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS bucket FROM {LOSSY}),
    r AS (SELECT user_id, bucket, avg(reading) AS reading, count(reading) AS k FROM l GROUP BY 1, 2),
    m AS (SELECT user_id, avg(reading) AS m, stddev_samp(reading) AS s FROM l GROUP BY 1),
    g AS (SELECT user_id, m, s, unnest(generate_series((SELECT min(bucket) FROM l), (SELECT max(bucket) FROM l),
            INTERVAL 1 DAY)) AS bucket FROM m)
    SELECT user_id, bucket, round(coalesce(r.reading, m + coalesce(s, 0) * {_Z}), 6) AS reading,
        CASE WHEN r.reading IS NOT NULL THEN 'real' WHEN m IS NOT NULL THEN 'synthetic' ELSE 'empty' END AS data_type,
        CASE WHEN r.reading IS NOT NULL THEN NULL WHEN r.k = 0 THEN 'error' ELSE 'missing' END AS reason
    FROM g LEFT JOIN r USING (user_id, bucket))"""


def filled(spark, folder):
    """Users by day: the mean reading, or a draw from the moments of the user."""
    rows = lossy(spark, folder)
    day = truncated(F.col("ts"), 86400)
    real = rows.groupBy("user_id", day.alias("bucket")).agg(
        F.avg("reading").alias("reading"),
        F.when(F.count("reading") == 0, F.lit("error")).alias("reason"),
    )
    ends = table(spark, folder, "events").agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    moments = rows.groupBy("user_id").agg(F.avg("reading").alias("_m"), F.stddev_samp("reading").alias("_s"))
    grid = fb.time_grid(moments, ["user_id", "_m", "_s"], ends["lo"], ends["hi"], DAY)
    grid = grid.withColumn("_day", floor_to(F.col("bucket"), DAY * 1_000_000))
    z = rng.normal(SEED, "reading", "fallback", "user_id", "_day")
    synthetic = F.col("_m") + F.coalesce("_s", F.lit(0.0)) * z
    out = fb.fill(grid, real, ["user_id"], "bucket", "reading", synthetic, "reason")
    return out.withColumn("reading", F.round("reading", 6))


@query("fallback_fill", f"SELECT * FROM {FILLED_SQL}")
def fallback_fill(spark, folder):
    return filled(spark, folder)


@query(
    "fallback_carry",
    f"""WITH r AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, avg(reading) AS reading
                   FROM {LOSSY} GROUP BY 1, 2),
        g AS (SELECT user_id, unnest(generate_series((SELECT min(bucket) FROM r), (SELECT max(bucket) FROM r),
                INTERVAL 1 DAY)) AS bucket FROM (SELECT DISTINCT user_id FROM events)),
        j AS (SELECT user_id, bucket, r.reading AS x, last_value(r.reading IGNORE NULLS) OVER
                (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS c,
                r.user_id IS NULL OR r.reading IS NULL AS gone FROM g LEFT JOIN r USING (user_id, bucket))
        SELECT user_id, bucket, round(c, 6) AS reading,
            CASE WHEN x IS NOT NULL THEN 'real' WHEN c IS NOT NULL THEN 'synthetic' ELSE 'empty' END AS data_type,
            CASE WHEN x IS NULL THEN 'missing' END AS reason
        FROM j""",
)
def fallback_carry(spark, folder):
    """Only the last good value repairs a gap; before the first one the row is empty."""
    rows = lossy(spark, folder)
    day = truncated(F.col("ts"), 86400)
    real = rows.groupBy("user_id", day.alias("bucket")).agg(F.avg("reading").alias("reading"))
    ends = table(spark, folder, "events").agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    users = rows.select("user_id").distinct()
    grid = fb.time_grid(users, ["user_id"], ends["lo"], ends["hi"], DAY)
    nothing = F.lit(None).cast("double")
    out = fb.fill(grid, real, ["user_id"], "bucket", "reading", nothing, carry=True)
    return out.withColumn("reading", F.round("reading", 6))


_LOST = duck.uniform(SEED, "y", "outage", "day_no", duck.text_id("event_type"))


def lossy_daily(spark, folder):
    """Daily totals of every type with three in ten days lost."""
    day = truncated(F.col("ts"), DAY)
    daily = table(spark, folder, "events").groupBy("event_type", day.alias("day")).agg(F.round(F.sum("value"), 4).alias("y"))
    daily = daily.withColumn("_day", floor_to(F.col("day"), DAY * 1_000_000))
    kept = rng.uniform(SEED, "y", "outage", "_day", rng.text_id("event_type")) >= 0.3
    return daily.withColumn("y", F.when(kept, F.col("y"))).drop("_day")


@query(
    "fallback_model",
    f"""WITH d AS (SELECT *, epoch_us(day) // 86400000000 AS day_no FROM (
                SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)),
        g AS (SELECT event_type, day, CASE WHEN {_LOST} >= 0.3::DOUBLE THEN total END AS y FROM d),
        k AS (SELECT *, row_number() OVER w AS pos FROM g WINDOW w AS (PARTITION BY event_type ORDER BY day)),
        n AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY day) AS dy FROM k WHERE y IS NOT NULL),
        o AS (SELECT *, lag(dy) OVER (PARTITION BY event_type ORDER BY day) AS ldy FROM n),
        f AS (SELECT event_type, greatest(-0.999::DOUBLE, least(0.999::DOUBLE, sum(dy * ldy) / sum(ldy * ldy))) AS phi FROM o GROUP BY 1),
        j AS (SELECT k.*, last_value(n.y IGNORE NULLS) OVER w AS ly, last_value(coalesce(n.dy, CASE WHEN n.y IS NOT NULL THEN 0 END) IGNORE NULLS) OVER w AS ldy,
                last_value(CASE WHEN n.y IS NOT NULL THEN k.pos END IGNORE NULLS) OVER w AS lpos
              FROM k LEFT JOIN n ON k.event_type = n.event_type AND k.day = n.day
              WINDOW w AS (PARTITION BY k.event_type ORDER BY k.day ROWS UNBOUNDED PRECEDING))
        SELECT j.event_type, j.day, round(coalesce(y, ly + ldy * phi * (1 - phi ** (pos - lpos)) / (1 - phi)), 4) AS y,
            CASE WHEN y IS NOT NULL THEN 'real' WHEN ly IS NOT NULL THEN 'synthetic' ELSE 'empty' END AS data_type,
            CASE WHEN y IS NOT NULL THEN 'real' WHEN ly IS NOT NULL THEN 'model' ELSE 'none' END AS source,
            CASE WHEN y IS NULL THEN 'missing' END AS error, day + INTERVAL 1 DAY AS emitted_at
        FROM j JOIN f ON j.event_type = f.event_type""",
)
def fallback_model(spark, folder):
    """Lost daily totals repaired by the fitted model of each type."""
    daily, key = lossy_daily(spark, folder), SeriesKey(("event_type",), "day")
    out = fb.fill_from_model(daily, key, "y", fit_ar(daily, key, "y"), F.col("day") + F.expr("interval 1 day"))
    return out.withColumn("y", F.round("y", 4))


@query(
    "synthetic_ratio",
    f"""SELECT user_id, count(*) FILTER (data_type = 'real') AS real_rows,
            count(*) FILTER (data_type = 'synthetic') AS synthetic_rows,
            count(*) FILTER (data_type = 'real') AS real_batches,
            count(*) FILTER (data_type = 'synthetic') AS synthetic_batches,
            round(count(*) FILTER (data_type = 'synthetic') / count(*) FILTER (data_type <> 'empty'), 8) AS synthetic_ratio,
            count(*) FILTER (data_type <> 'empty') > 10 AND count(*) FILTER (data_type = 'synthetic')
              / count(*) FILTER (data_type <> 'empty') > 0.8::DOUBLE AS warning
        FROM {FILLED_SQL} GROUP BY 1""",
)
def synthetic_ratio(spark, folder):
    out = fb.synthetic_ratio(filled(spark, folder), ["user_id"], "bucket")
    return out.withColumn("synthetic_ratio", F.round("synthetic_ratio", 8))


@query(
    "monitor_counts",
    f"""WITH b AS (SELECT 'user_' || user_id % 10 AS streamer, bucket, data_type, count(*) AS n,
                     bool_or(coalesce(reason = 'error', false)) AS e FROM {FILLED_SQL} GROUP BY 1, 2, 3)
        SELECT streamer, sum(n)::BIGINT AS data_points,
            coalesce(sum(n) FILTER (data_type = 'real'), 0)::BIGINT AS real_data,
            coalesce(sum(n) FILTER (data_type = 'synthetic'), 0)::BIGINT AS synthetic_data,
            count(*) FILTER (e) AS errors, max(bucket) AS last_data_time,
            count(*) FILTER (data_type = 'real') AS real_batches,
            count(*) FILTER (data_type = 'synthetic') AS synthetic_batches,
            count(*) FILTER (data_type = 'empty') AS empty_batches
        FROM b GROUP BY 1""",
)
def monitor_counts(spark, folder):
    streamer = F.concat(F.lit("user_"), (F.col("user_id") % 10).cast("string"))
    return fb.monitor(filled(spark, folder), streamer, "bucket", F.col("bucket"))


@query(
    "run_stats",
    """WITH b AS (SELECT event_type AS generator, epoch_us(ts) // 3600000000 AS batch, count(*) AS n,
                    bool_or(value > 200) AS d, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1, 2)
       SELECT generator, count(*) AS batches_generated, sum(n)::BIGINT AS records_generated,
            count(*) FILTER (d) AS drift_events, (epoch_us(max(z)) - epoch_us(min(a))) / 1000000.0::DOUBLE AS runtime_seconds,
            round(sum(n) / ((epoch_us(max(z)) - epoch_us(min(a))) / 1000000.0::DOUBLE), 8) AS records_per_second
       FROM b GROUP BY 1""",
)
def run_stats(spark, folder):
    """Statistics of an emit log: hourly batches per generator, large values marking drift."""
    events = table(spark, folder, "events")
    hour = floor_to(F.col("ts"), 3600 * 1_000_000)
    out = fb.run_statistics(events, F.col("event_type"), hour, F.col("value") > 200, "ts")
    return out.withColumn("records_per_second", F.round("records_per_second", 8))


