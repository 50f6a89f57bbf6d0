"""Queries: landed payloads, history ranges and file sinks.

Payloads are packed from every event (two points each, one payload per row, no grouping) and
unpacked again; the oracle is the plain selection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftloom.functions.scalars import micros_of, truncated
from driftloom.operators.series import SeriesKey
from driftloom.plans import duck
from driftloom.plans.tables import query, table
from driftloom.session import fresh_path
from driftloom.sinks import writers
from driftloom.sinks.committed import read_committed, register_sink
from driftloom.sources import history as h
from driftloom.sources.custom import register_source
from driftloom.sources import payloads as p
from driftloom.streaming.runner import drain

SEED = 42


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "event_type", "value")


def _seconds(ts):
    return F.floor(micros_of(F.col(ts)) / 1_000_000).cast("long")


def packed(events, body):
    return events.select("event_id", body.alias("payload"))


def _map_text(v):
    return F.struct(
        v.cast("string").alias("1. open"),
        (v + 1).cast("string").alias("2. high"),
        (v - 1).cast("string").alias("3. low"),
        F.lit("n/a").alias("4. close"),
        F.col("event_id").cast("string").alias("5. volume"),
    )


def map_body():
    points = F.map_from_arrays(
        F.array(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.date_format(F.col("ts") + F.expr("interval 1 year"), "yyyy-MM-dd HH:mm:ss"),
        ),
        F.array(_map_text(F.col("value")), _map_text(F.col("value") * 2)),
    )
    meta = F.map_from_arrays(F.array(F.lit("1. Information")), F.array(F.col("event_type")))
    return F.to_json(F.struct(meta.alias("Meta Data"), points.alias("Time Series (5min)")))


@query(
    "ingest_map",
    """WITH x AS (SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, value AS v FROM events
                  UNION ALL
                  SELECT event_id, date_trunc('second', ts + INTERVAL 1 YEAR)::TIMESTAMP, value * 2 FROM events)
       SELECT event_id, ts, v AS open, v + 1 AS high, v - 1 AS low, NULL::DOUBLE AS close,
              event_id::DOUBLE AS volume FROM x""",
)
def ingest_map(spark, folder):
    return p.map_payload(packed(_events(spark, folder), map_body()), "payload", ["event_id"])


def array_body():
    v, id_ = F.col("value"), F.col("event_id").cast("double")
    quote = F.struct(
        F.array(v, v * 2).alias("open"),
        F.array(v + 1, F.lit(None)).alias("high"),
        F.array(v - 1, v * 2).alias("low"),
        F.array(v, v).alias("close"),
        F.array(id_, id_).alias("volume"),
    )
    result = F.struct(
        F.array(_seconds("ts"), _seconds("ts") + 60).alias("timestamp"),
        F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )
    body = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return F.to_json(body, {"ignoreNullFields": "false"})


@query(
    "ingest_arrays",
    """SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS ts, value AS open, value + 1 AS high,
            value - 1 AS low, value AS close, event_id::DOUBLE AS volume FROM events
       UNION ALL
       SELECT event_id, make_timestamp((epoch_us(ts) // 1000000 + 60) * 1000000), value * 2, NULL, value * 2,
            value, event_id::DOUBLE FROM events""",
)
def ingest_arrays(spark, folder):
    return p.array_payload(packed(_events(spark, folder), array_body()), "payload", ["event_id"])


def record_body():
    v = F.col("value")
    records = [
        F.struct((_seconds("ts") + shift).alias("time"), (v * scale).alias("open"), v.alias("close"))
        for shift, scale in ((0, 1), (3600, 3))
    ]
    return F.to_json(F.struct(F.lit("Success").alias("Response"), F.array(*records).alias("Data")))


@query(
    "ingest_records",
    """SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS ts, value AS open, value AS close
       FROM events
       UNION ALL
       SELECT event_id, make_timestamp((epoch_us(ts) // 1000000 + 3600) * 1000000), value * 3, value FROM events""",
)
def ingest_records(spark, folder):
    return p.record_payload(packed(_events(spark, folder), record_body()), "payload", ["event_id"], ["open", "close"])


# Fixed texts: one payload of every bad shape, by event id modulo 8 (0 to 2 are good ones).
BAD = {
    3: '{"Error Message": "Invalid API call"}',
    4: '{"Note": "Thank you! Our standard API call frequency is 5 per minute"}',
    5: '{"Response": "Error", "Message": "no such symbol"}',
    6: '{"chart": {"result": []}}',
    7: "{broken",
}


def mixed_body():
    """Payload shape by event id: every event gets one, good or bad."""
    kind = F.col("event_id") % 8
    text = F.when(kind == 0, map_body()).when(kind == 1, array_body()).when(kind == 2, record_body())
    for i, body in BAD.items():
        text = text.when(kind == i, F.lit(body))
    return text


@query(
    "ingest_bad_split",
    """SELECT event_id, [ 'map', 'arrays', 'records'][(event_id % 8 + 1)::INTEGER] AS shape,
            CASE event_id % 8 WHEN 3 THEN 'error' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'error'
              WHEN 6 THEN 'empty' WHEN 7 THEN 'malformed' END AS reason
       FROM events""",
)
def ingest_bad_split(spark, folder):
    return p.classified(packed(_events(spark, folder), mixed_body()), "payload").select("event_id", "shape", "reason")


# --- history -----------------------------------------------------------------


@query(
    "range_filter",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'""",
)
def range_filter(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return h.between(orders, "o_orderdate", "1996-01-01", "1998-12-31")


@query(
    "warm_start",
    """SELECT event_id, ts, value FROM events
       WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""",
)
def warm_start(spark, folder):
    return h.last_days(table(spark, folder, "events").select("event_id", "ts", "value"), "ts", 20)


def _bars_sql(kind, source, series, ts, value, tie, seconds):
    width = seconds * 1_000_000
    return f"""SELECT '{kind}' AS kind, '{source}' AS source, {series} AS series,
            make_timestamp(epoch_us({ts}) // {width} * {width}) AS bucket,
            arg_min({value}, ({ts}, {tie})) AS open, max({value}) AS high, min({value}) AS low,
            arg_max({value}, ({ts}, {tie})) AS close, count(*) AS volume, {seconds}::BIGINT AS bar_seconds
        FROM {source} GROUP BY series, bucket"""


@query(
    "span_granularity",
    " UNION ALL ".join(
        f"({_bars_sql(*args)})"
        for args in [
            ("map", "events", "event_type", "ts", "value", "event_id", 86400),
            ("arrays", "events", "event_type", "ts", "value", "event_id", 1800),
            ("records", "events", "event_type", "ts", "value", "event_id", 3600),
            ("map", "orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey", 604800),
            ("arrays", "orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey", 604800),
            ("records", "orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey", 86400),
        ]
    ),
)
def span_granularity(spark, folder):
    out = None
    for source, series, ts, value, tie in [
        ("events", "event_type", "ts", "value", "event_id"),
        ("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey"),
    ]:
        rows = table(spark, folder, source).withColumnRenamed(series, "series")
        for kind in h.GRANULARITY:
            bars = h.bars_by_span(rows, SeriesKey(("series",), ts, (tie,)), value, F.lit(1), kind)
            tagged = bars.select(F.lit(kind).alias("kind"), F.lit(source).alias("source"), "*")
            out = tagged if out is None else out.unionByName(tagged)
    return out


@query(
    "default_series",
    f"""SELECT user_id, timestamp, {duck.rounded(duck.normal(SEED, 'value', 'default', 'user_id', 'd'))} AS value
        FROM (SELECT user_id, timestamp, epoch_us(timestamp) // 86400000000 AS d
              FROM (SELECT user_id, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP,
                        date_trunc('day', max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS timestamp
                    FROM events GROUP BY user_id))""",
)
def default_series(spark, folder):
    events = table(spark, folder, "events")
    day = truncated(F.col("ts"), 86400)
    bounds = events.groupBy("user_id").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    out = h.default_series(bounds, ["user_id"], "first", "last", SEED, "user_id")
    return out.withColumn("value", F.round("value", 6))


@query(
    "default_point",
    f"""SELECT user_id, t AS timestamp, {duck.rounded(duck.normal(SEED, 'value', 'default', 'user_id', 'epoch_us(t) // 86400000000'))} AS value
        FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id)""",
)
def default_point(spark, folder):
    """One default point per user, at the user's last time."""
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    return h.default_point(last, ["user_id"], "t", SEED, "user_id").withColumn("value", F.round("value", 6))


# --- sinks: written to the shared folder and read back -----------------------

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*ORDER_COLUMNS)


def _twice(spark, folder, fmt):
    """Overwrite, then append the same batch."""
    orders, path = _orders(spark, folder), fresh_path(spark, f"sink-{fmt}")
    writers.write_files(orders, path, fmt, "overwrite")
    writers.write_files(orders, path, fmt, "append")
    return orders.schema, path


@query("sink_csv", f"{ORDER_SQL} UNION ALL {ORDER_SQL}")
def sink_csv(spark, folder):
    schema, path = _twice(spark, folder, "csv")
    return spark.read.schema(schema).option("header", True).csv(path)


@query("sink_json", f"{ORDER_SQL} UNION ALL {ORDER_SQL}")
def sink_json(spark, folder):
    schema, path = _twice(spark, folder, "json")
    return spark.read.schema(schema).json(path)


@query(
    "sink_parquet",
    "SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders UNION ALL "
    "SELECT o_orderkey, NULL, o_orderpriority FROM orders",
)
def sink_parquet(spark, folder):
    """Two appended batches with different columns; the reader merges the schemas."""
    orders, path = _orders(spark, folder), fresh_path(spark, "sink-parquet")
    writers.write_files(orders.select("o_orderkey", "o_totalprice"), path, "parquet")
    writers.write_files(orders.select("o_orderkey", "o_orderpriority"), path, "parquet")
    return h.read_history(spark, path, merge_schema=True).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("kafka_payload", ORDER_SQL)
def kafka_payload(spark, folder):
    orders = _orders(spark, folder)
    ddl = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return writers.kafka_payload(orders).select(F.from_json("value", ddl).alias("m")).select("m.*")


SAMPLED = f"{duck.uniform(SEED, 'sample', 'row', 'o_orderkey')} < 0.25::DOUBLE"


@query("sample_export", f"{ORDER_SQL} WHERE {SAMPLED}")
def sample_export(spark, folder):
    orders, path = _orders(spark, folder), fresh_path(spark, "sample")
    writers.export_sample(orders, path, "json", 0.25, SEED, "o_orderkey")
    return spark.read.schema(orders.schema).json(path)


@query("parquet_scan", "SELECT * FROM supplier")
def parquet_scan(spark, folder):
    return h.read_history(spark, f"{folder}/supplier.parquet")



# --- a user's own source: quotes by order key ---------------------------------


def _quotes(lo, hi, options):
    """The quotes of the keys in [lo, hi), made where the slice is read, a bounded batch at a time."""
    for start in range(lo, hi, 10_000):
        keys = np.arange(start, min(start + 10_000, hi), dtype=np.int64)
        columns = [pa.array(keys), pa.array(keys * 7919 % 10007 / 100.0)]
        yield pa.RecordBatch.from_arrays(columns, names=["quote_key", "quote"])


def _quote_source(reader, spark, folder):
    """The quotes of all keys that the orders span; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    register_source(spark, "quotes", "quote_key bigint, quote double", _quotes, "quote_key")
    span = table(spark, folder, "orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    lo, hi = (0, 0) if span.lo is None else (span.lo, span.hi + 1)
    return reader.format("quotes").option("start", str(lo)).option("end", str(hi)).load()


def _quoted(spark, folder, quotes):
    """Every order with its quote; an order without a key has none."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(quotes, F.col("o_orderkey") == F.col("quote_key"), "left").drop("quote_key")


QUOTED_SQL = "SELECT o_orderkey, o_totalprice, ((o_orderkey * 7919) % 10007 + 10007) % 10007 / 100.0::DOUBLE AS quote FROM orders"


@query("custom_source", QUOTED_SQL)
def custom_source(spark, folder):
    """Orders with the quotes that a user's own source serves in slices of their keys."""
    return _quoted(spark, folder, _quote_source(spark.read, spark, folder))


@query("stream_custom_source", QUOTED_SQL)
def stream_custom_source(spark, folder):
    """The same source as a stream, drained into the sink with a commit protocol."""
    path, quotes = fresh_path(spark, "quotes"), _quote_source(spark.readStream, spark, folder)
    register_sink(spark, "committed_parts")
    writer = quotes.writeStream.format("committed_parts").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    drain(writer)
    return _quoted(spark, folder, read_committed(spark, path, quotes.schema))
