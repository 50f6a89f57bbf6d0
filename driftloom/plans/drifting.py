"""Queries: drift, its schedule and its measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions.scalars import floor_to, micros_of
from driftloom.operators import drift as d
from driftloom.operators.generate import cumulative
from driftloom.plans import duck
from driftloom.plans.tables import query, table
from driftloom.schema import TableSpec

SEED, MAGNITUDE = 42, 0.5
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDERS = TableSpec.of(
    "orders",
    {
        "o_totalprice": {"type": "float", "mean": 250000, "std": 140000, "min": 1000, "max": 500000},
        "o_orderpriority": {"type": "category", "categories": PRIORITIES},
        "o_custkey": {"type": "int"},
    },
    SEED,
)
# An event whose gate is open for the category at this magnitude.
EVENT = next(e for e in range(100) if d.gate_open(SEED, "o_orderpriority", MAGNITUDE, e))


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


PRICE = ORDERS["o_totalprice"]
SHIFT = d.drift_direction(SEED, "o_totalprice", EVENT) * MAGNITUDE * PRICE.std
NUMERIC_SQL = f"""SELECT o_orderkey, o_custkey, {duck.clipped('v', PRICE.low, PRICE.high)} AS o_totalprice
    FROM (SELECT o_orderkey, o_custkey, o_totalprice + {duck.num(SHIFT)} AS v FROM orders)"""
DRIFTED_EDGES = cumulative(
    d.drifted_probabilities(ORDERS["o_orderpriority"], SEED, MAGNITUDE, EVENT)
)
CATEGORY_SQL = f"""SELECT o_orderkey, CASE WHEN hit < {duck.num(MAGNITUDE)} THEN
        {duck.weighted('u', [duck.text(p) for p in PRIORITIES], [duck.num(e) for e in DRIFTED_EDGES])}
        ELSE o_orderpriority END AS o_orderpriority
    FROM (SELECT o_orderkey, o_orderpriority,
            {duck.uniform(SEED, 'o_orderpriority', 'drift/mask', 'o_orderkey', str(EVENT))} AS hit,
            {duck.uniform(SEED, 'o_orderpriority', 'drift/pick', 'o_orderkey', str(EVENT))} AS u
          FROM orders)"""


@query("drift_numeric", NUMERIC_SQL)
def drift_numeric(spark, folder):
    out = d.drift(_orders(spark, folder), ORDERS, MAGNITUDE, "o_orderkey", EVENT)
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("drift_category", CATEGORY_SQL)
def drift_category(spark, folder):
    out = d.drift(_orders(spark, folder), ORDERS, MAGNITUDE, "o_orderkey", EVENT)
    return out.select("o_orderkey", "o_orderpriority")


# Batches of ten minutes of event time; drift six hours and some after the last one, no multiple of a batch.
BATCH_SECONDS, DRIFT_SECONDS = 600, 6 * 3600 + 250
WIDTH = DRIFT_SECONDS * 1_000_000
EVENTS_SQL = f"""b AS (SELECT *, floor(epoch_us(ts) / {BATCH_SECONDS * 1_000_000}.0::DOUBLE)::BIGINT AS batch FROM events),
        s AS (SELECT batch, min(epoch_us(ts)) AS t, min(ts) AS batch_ts FROM b GROUP BY batch),
        o AS (SELECT min(t) AS o FROM s),
        d(t) AS (SELECT o FROM o UNION ALL
                 SELECT min(s.t) FROM s, d WHERE s.t >= d.t + {WIDTH} HAVING min(s.t) IS NOT NULL),
        f AS (SELECT floor((d.t - o) / {WIDTH}.0::DOUBLE)::BIGINT AS epoch, min(batch) AS batch
              FROM d, o, s WHERE s.t = d.t AND d.t > o GROUP BY 1)"""
TYPES = ["click", "view", "signup", "error", "purchase"]
STREAM = TableSpec.of(
    "events",
    {
        "value": {"type": "float", "mean": 50, "std": 50, "min": 0},
        "event_type": {"type": "category", "categories": TYPES},
    },
    SEED,
)


def _batched(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    return events.withColumn("batch", floor_to(F.col("ts"), BATCH_SECONDS * 1_000_000))


def _scheduled(spark, folder):
    events = _batched(spark, folder)
    origin = events.agg(F.min(micros_of(F.col("ts")))).scalar()
    return d.drift_on_schedule(events, STREAM, MAGNITUDE, "ts", "batch", origin, DRIFT_SECONDS, "event_id")


def _schedule_sql() -> str:
    value, kind = STREAM["value"], STREAM["event_type"]
    moved = ", ".join(
        f"greatest(0.01::DOUBLE, least(1.0::DOUBLE, {duck.num(p)} + {duck.num(MAGNITUDE)} * "
        f"{duck.normal(SEED, 'event_type', f'drift/p{k}', 'epoch')}))"
        for k, p in enumerate(kind.probabilities)
    )
    edges = [f"list_sum(p[1:{k}]) / list_sum(p)" for k in range(1, len(TYPES))]
    return f"""WITH RECURSIVE {EVENTS_SQL},
        q AS (SELECT *, [{moved}] AS p,
                CASE WHEN {duck.uniform(SEED, 'value', 'drift/direction', 'epoch')} < 0.5 THEN -1 ELSE 1 END
                  * {duck.num(MAGNITUDE * value.std)} AS shift,
                {duck.uniform(SEED, 'event_type', 'drift/gate', 'epoch')} < {duck.num(MAGNITUDE)} AS open
              FROM f),
        r AS (SELECT b.*, q.epoch, q.p, q.open, value + q.shift AS v,
                {duck.uniform(SEED, 'event_type', 'drift/mask', 'event_id', 'q.epoch')} AS hit,
                {duck.uniform(SEED, 'event_type', 'drift/pick', 'event_id', 'q.epoch')} AS u
              FROM b LEFT JOIN q ON b.batch = q.batch)
        SELECT event_id, ts, batch, epoch, epoch IS NOT NULL AS drifted,
            CASE WHEN epoch IS NULL THEN value WHEN v < 0 THEN 0.0::DOUBLE ELSE v END AS value,
            CASE WHEN epoch IS NOT NULL AND open AND hit < {duck.num(MAGNITUDE)} THEN
              {duck.weighted('u', [duck.text(t) for t in TYPES], edges)} ELSE event_type END AS event_type
        FROM r"""


@query("drift_schedule", _schedule_sql())
def drift_schedule(spark, folder):
    return _scheduled(spark, folder)


@query(
    "drift_counts",
    f"""WITH RECURSIVE {EVENTS_SQL}
        SELECT 'events' AS generator, count(*) AS batches, count(f.batch) AS drift_events,
            max(batch_ts) FILTER (f.batch IS NOT NULL) AS last_drift FROM s LEFT JOIN f ON s.batch = f.batch""",
)
def drift_counts(spark, folder):
    rows = _scheduled(spark, folder).withColumn("generator", F.lit("events"))
    return d.drift_counts(rows, "generator", "batch", "drifted", "ts")


@query(
    "drift_measure",
    f"""WITH x AS ({NUMERIC_SQL}), y AS ({CATEGORY_SQL}),
        m AS (SELECT avg(o_totalprice) AS b, stddev_samp(o_totalprice) AS s FROM orders),
        n AS (SELECT avg(o_totalprice) AS a FROM x),
        p AS (SELECT o_orderpriority AS c, count(*) / (SELECT count(*)::DOUBLE FROM orders) AS f
              FROM orders GROUP BY 1),
        q AS (SELECT o_orderpriority AS c, count(*) / (SELECT count(*)::DOUBLE FROM y) AS f
              FROM y GROUP BY 1)
        SELECT 'o_totalprice' AS column, NULL AS category, round(b, 4) AS before, round(a, 4) AS after,
            round((a - b) / s, 6) AS change FROM m, n
        UNION ALL
        SELECT 'o_orderpriority', coalesce(p.c, q.c), round(coalesce(p.f, 0), 4), round(coalesce(q.f, 0), 4),
            round(coalesce(q.f, 0) - coalesce(p.f, 0), 6) FROM p FULL JOIN q ON p.c = q.c""",
)
def drift_measure(spark, folder):
    before = _orders(spark, folder)
    after = d.drift(before, ORDERS, MAGNITUDE, "o_orderkey", EVENT)
    numeric = d.mean_shift(before, after, ["o_totalprice"]).select(
        "column",
        F.lit(None).cast("string").alias("category"),
        F.round("mean_before", 4).alias("before"),
        F.round("mean_after", 4).alias("after"),
        F.round("shift_in_std", 6).alias("change"),
    )
    shares = d.share_change(before, after, "o_orderpriority").select(
        "column",
        "category",
        F.round("share_before", 4).alias("before"),
        F.round("share_after", 4).alias("after"),
        F.round("share_change", 6).alias("change"),
    )
    return numeric.unionByName(shares)
