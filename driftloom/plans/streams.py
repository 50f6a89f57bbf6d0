"""Queries: streams over the event files, drained, and read back as tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from driftloom.operators.fallback import fill_stream
from driftloom.operators.forecast import fit_ar, fit_moments
from driftloom.operators.generate import generate, stamp
from driftloom.plans import duck
from driftloom.plans.fallbacks import lossy_daily
from driftloom.plans.generation import PRESET, duck_table, rounded
from driftloom.plans.repairing import GONE
from driftloom.plans.tables import ORACLES, query, table
from driftloom.operators.series import SeriesKey, knocked_out
from driftloom.session import cut_lineage, fresh_path
from driftloom.streaming import bars, buffer, fanout, monitor, repair, runner
from driftloom.streaming.sources import landed_files


def event_stream(spark, folder):
    """The events as a stream of landed files."""
    schema = table(spark, folder, "events").schema
    return landed_files(spark, folder, schema, glob="events.parquet")


@query(
    "stream_generate",
    f"SELECT *, 'preset' AS generator FROM ({duck_table(PRESET, 'events', 'event_id', ['event_id'])})",
)
def stream_generate(spark, folder):
    """Rows generated for every streamed event id."""
    path = fresh_path(spark, "stream")
    made = rounded(generate(event_stream(spark, folder), PRESET, "event_id", ["event_id"]), PRESET)
    sink = fanout.files("table", f"{path}/out")
    runner.drain(fanout.fan_out(stamp(made, "preset"), [sink], f"{path}/status", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").drop("batch_id", "emitted_at")


def tagged_stream(spark, folder):
    """Streamed readings with provenance: a lost reading is an error."""
    lossy = knocked_out(event_stream(spark, folder), "value", 42, 0.3, "event_id", "reading")
    real = F.col("reading").isNotNull()
    return lossy.withColumns(
        {
            "data_type": F.when(real, F.lit("real")).otherwise(F.lit("synthetic")),
            "reason": F.when(~real, F.lit("error")),
        }
    )


@query(
    "stream_monitor",
    f"""SELECT event_type AS streamer, CASE WHEN {GONE} THEN 'synthetic' ELSE 'real' END AS data_type,
            count(*) AS data_points, count(*) FILTER ({GONE}) AS errors, max(ts) AS last_data_time
        FROM events GROUP BY 1, 2""",
)
def stream_monitor(spark, folder):
    path = fresh_path(spark, "monitor")
    counts = monitor.monitor_counts(tagged_stream(spark, folder), F.col("event_type"), "ts")
    runner.drain(monitor.snapshots(counts, f"{path}/out", f"{path}/checkpoint"))
    return monitor.current_counts(spark, f"{path}/out")


@query(
    "stream_ohlcv",
    """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, arg_min(value, (ts, event_id)) AS open,
            max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
            count(*) AS volume
        FROM events GROUP BY 1, 2""",
)
def stream_ohlcv(spark, folder):
    """Daily bars of the streamed events by event time; a late row would fail the query."""
    path = fresh_path(spark, "bars")
    key = SeriesKey(("event_type",), "ts", ("event_id",))
    made = bars.bars(event_stream(spark, folder), key, "value", F.lit(1), "1 day", "1 day")
    ended = runner.drain(bars.keep_bars(made, f"{path}/out", f"{path}/checkpoint"))
    if late := bars.late_groups(ended):
        raise ValueError(f"{late} groups of late rows")
    return bars.current_bars(spark, f"{path}/out", key.keys)


_M = "(SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)"


@query(
    "stream_fallback",
    f"""SELECT event_id, e.event_type, CASE WHEN {GONE} THEN round(m + s * {duck.normal(42, 'reading', 'fallback', 'event_id')}, 6) ELSE value END AS reading,
            CASE WHEN {GONE} THEN 'model' ELSE 'real' END AS source, CASE WHEN {GONE} THEN 'error' END AS error, ts AS emitted_at
        FROM events e JOIN {_M} m ON e.event_type = m.event_type""",
)
def stream_fallback(spark, folder):
    """Lost readings of a stream repaired where they pass, from the stored moments of their type."""
    path = fresh_path(spark, "repair")
    fit_moments(table(spark, folder, "events"), SeriesKey(("event_type",), "ts"), "value").write.parquet(f"{path}/moments")
    model = spark.read.parquet(f"{path}/moments")
    repaired = fill_stream(tagged_stream(spark, folder), model, ["event_type"], "reading", 42, "event_id", F.col("ts"))
    rows = repaired.select("event_id", "event_type", F.when(F.col("source") == "model", F.round("reading", 6)).otherwise(F.col("reading")).alias("reading"), "source", "error", "emitted_at")
    runner.drain(fanout.fan_out(rows, [fanout.files("repaired", f"{path}/out")], f"{path}/status", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").drop("batch_id")


@query("stream_fallback_model", ORACLES["fallback_model"])
def stream_fallback_model(spark, folder):
    """The daily totals land in three files, one micro-batch each, and are repaired from the stored models as they pass."""
    path, key = fresh_path(spark, "model-repair"), SeriesKey(("event_type",), "day")
    daily = cut_lineage(lossy_daily(spark, folder))
    fit_ar(daily, key, "y").write.parquet(f"{path}/model")
    ends = daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    days = lambda upto: F.timestamp_diff("DAY", ends["lo"], upto)
    parts = daily.withColumn("_part", F.floor(days(F.col("day")) * 3 / (days(ends["hi"]) + 1)))
    for part in range(3):
        parts.where(F.col("_part") == part).select(*daily.columns).coalesce(1).write.mode("append").parquet(f"{path}/landed")
    stream = landed_files(spark, f"{path}/landed", daily.schema, files_per_batch=1)
    model = spark.read.parquet(f"{path}/model")
    runner.drain(repair.repair(stream, key, "y", model, F.col("day") + F.expr("interval 1 day"), path, f"{path}/checkpoint"))
    return repair.repaired(spark, path).withColumn("y", F.round("y", 4))


@query(
    "stream_continuous",
    duck_table(PRESET, "events", "event_id", ["event_id"]),
)
def stream_continuous(spark, folder):
    """The endless generator, started, stopped once it has passed all event ids, and read back by id."""
    path, events = fresh_path(spark, "endless"), table(spark, folder, "events").select("event_id")
    last = events.agg(F.max("event_id")).first()[0]
    if last is None or last < 0:  # no id that the generator passes
        return rounded(generate(events.where("event_id >= 0"), PRESET, "event_id", ["event_id"]), PRESET)
    done = []

    def emit(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
        done.append(batch_id)

    size = max(1000, (last + 1) // 4)
    running = runner.continuous_generator(spark, PRESET, size, f"{path}/checkpoint", emit).trigger(processingTime="0 seconds").start()
    try:
        while len(done) * size <= last:
            if not running.isActive:
                raise running.exception() or RuntimeError("the generator ended before it had passed all ids")
            time.sleep(0.1)
    finally:
        running.stop()
    made = spark.read.parquet(f"{path}/out").drop("batch_id", "generator", "drifted").withColumnRenamed("row_id", "event_id")
    return rounded(made.join(events, "event_id", "left_semi"), PRESET)


def _broken(batch, batch_id):
    raise RuntimeError("target is down")


@query(
    "stream_fanout",
    """SELECT s.sink, s.ok, CASE WHEN s.ok THEN e.n END AS rows
       FROM (VALUES ('json', true), ('parquet', true), ('clicks', true), ('broken', false),
                    ('listener:counted', true), ('listener:_broken', false)) s(sink, ok),
         LATERAL (SELECT count(*) AS n FROM events WHERE s.sink <> 'clicks' OR event_type = 'click') e""",
)
def stream_fanout(spark, folder):
    """Three file sinks (one for a single generator), one that fails, and two listeners; rows per target."""
    path = fresh_path(spark, "fanout")
    stream = event_stream(spark, folder).withColumn("generator", F.col("event_type"))
    sinks = [
        fanout.files("json", f"{path}/json", "json"),
        fanout.files("parquet", f"{path}/parquet"),
        fanout.files("clicks", f"{path}/clicks", generators=("click",)),
        fanout.Sink("broken", _broken),
    ]

    def counted(batch, batch_id):
        batch.select("event_id").write.mode("overwrite").parquet(f"{path}/listener:counted/batch_id={batch_id}")

    runner.drain(fanout.fan_out(stream, sinks, f"{path}/status", f"{path}/checkpoint", [counted, _broken], retry_failed=False))
    counts = None
    for name, fmt in (("json", "json"), ("parquet", "parquet"), ("clicks", "parquet"), ("listener:counted", "parquet")):
        rows = spark.read.schema("event_id bigint").format(fmt).load(f"{path}/{name}")
        one = rows.agg(F.lit(name).alias("sink"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return fanout.status_of(spark, f"{path}/status").join(counts, "sink", "left").select("sink", "ok", "rows")


@query(
    "stream_bounded",
    """SELECT user_id, event_id, ts, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""",
)
def stream_bounded(spark, folder):
    """The newest twenty readings per user as bounded state of the stream."""
    checkpoint = fresh_path(spark, "buffer")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buffer.ROCKSDB)
    try:
        kept = buffer.buffered(event_stream(spark, folder), "user_id", ["ts", "event_id", "value"], ["ts", "event_id"], 20, 4)
        runner.drain(buffer.keep_buffer(kept, checkpoint))
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return buffer.latest(spark, checkpoint, "user_id", ["ts", "event_id"], 20)


@query("stream_metrics", "SELECT 1::BIGINT AS batches, count(*) AS records FROM events")
def stream_metrics(spark, folder):
    """Batches and records of a drained stream, from its progress events; their times differ from run to run."""
    path = fresh_path(spark, "metrics")
    log = monitor.ProgressLog(spark, f"{path}/metrics")
    spark.streams.addListener(log)
    try:
        sink = fanout.files("table", f"{path}/out")
        writer = fanout.fan_out(event_stream(spark, folder), [sink], f"{path}/status", f"{path}/checkpoint")
        runner.drain(writer.queryName(f"events_{path[-8:]}"))
        deadline = time.time() + 60
        while log.pending() == 0:
            if time.time() > deadline:
                raise TimeoutError("no progress event within 60 seconds")
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    log.flush()
    return monitor.metrics(spark.read.schema(monitor.METRIC_SCHEMA).parquet(f"{path}/metrics").where("rows > 0")).select("batches", "records")


