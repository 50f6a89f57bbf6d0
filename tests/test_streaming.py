import os
import time

import pytest
from pyspark.sql import functions as F

from driftloom.operators.generate import generate, row_ids
from driftloom.plans import streams
from driftloom.plans.streams import stream_bounded  # noqa: F401  (registers the queries)
from driftloom.schema import PRESET_SERIES, PRESET_TABULAR, TableSpec
from driftloom.session import cut_lineage, fresh_path
from driftloom.streaming import buffer, fanout, monitor, runner
from driftloom.streaming.sources import continuous_rows, landed_files

SPEC = TableSpec.of("preset", PRESET_TABULAR)


@pytest.fixture
def landed(spark):
    """Four files of fifty rows each."""
    path = fresh_path(spark, "landed")
    for part in range(4):
        ids = spark.range(part * 50, part * 50 + 50).select(
            "id", (F.col("id") % 3).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
            F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("generator"),
        )
        ids.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def stream_of(spark, path, per_batch=1):
    return landed_files(spark, path, spark.read.parquet(path).schema, files_per_batch=per_batch)


def test_bars_equal_the_batch_form_and_late_rows_are_reported(spark):
    from driftloom.operators.series import SeriesKey, ohlcv
    from driftloom.streaming import bars

    key, path, out = SeriesKey(("k",), "ts", ("id",)), fresh_path(spark, "landed"), fresh_path(spark, "bars")
    ids = lambda a, b: spark.range(a, b).select(
        "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.sin("id").alias("v"))
    for part in range(3):
        ids(part * 100, part * 100 + 100).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    made = bars.bars(stream_of(spark, path), key, "v", F.lit(1), "30 minutes", "10 minutes")
    writer = bars.keep_bars(made, f"{out}/t", f"{out}/c")
    assert bars.late_groups(runner.drain(writer)) == 0
    half = F.timestamp_micros(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800).cast("long") * 1_800_000_000).cast("timestamp_ntz")
    want = sorted(map(str, ohlcv(ids(0, 300), key, "v", F.lit(1), half).collect()))
    got = bars.current_bars(spark, f"{out}/t", key.keys)
    assert sorted(map(str, got.collect())) == want and got.where("k is null").count() > 0
    # rows of the first minutes come again, long after the watermark has passed them
    ids(0, 5).coalesce(1).write.mode("append").parquet(path)
    again = bars.keep_bars(bars.bars(stream_of(spark, path), key, "v", F.lit(1), "30 minutes", "10 minutes"), f"{out}/t", f"{out}/c")
    query = runner.drain(again)
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) >= 3
    assert sorted(map(str, bars.current_bars(spark, f"{out}/t", key.keys).collect())) == want


def test_fan_out_isolates_failures_and_filters(spark, landed):
    out, seen = fresh_path(spark, "out"), []

    def count(batch, batch_id):
        seen.append(batch.count())

    def broken(batch, batch_id):
        raise RuntimeError("down")

    sinks = [
        fanout.files("all", f"{out}/all"),
        fanout.Sink("broken", broken),
        fanout.files("odd", f"{out}/odd", "csv", ("g1",)),
        fanout.console("screen", rows=1),
    ]
    runner.drain(fanout.fan_out(stream_of(spark, landed), sinks, f"{out}/status", f"{out}/cp", [broken, count], retry_failed=False))
    status = fanout.status_of(spark, f"{out}/status").toPandas()
    assert status.groupby("sink").ok.all().to_dict() == {
        "all": True, "broken": False, "odd": True, "screen": True, "listener:broken": False, "listener:count": True,
    }
    assert status.batch_id.nunique() == 4 and seen == [50] * 4
    assert spark.read.parquet(f"{out}/all").count() == 200
    assert spark.read.option("header", True).csv(f"{out}/odd").count() == 100


def test_failed_batch_is_repeated_without_duplicates(spark, landed):
    out, state = fresh_path(spark, "out"), {"fail": True}

    def flaky(batch, batch_id):
        if state["fail"]:
            raise RuntimeError("down")

    def start():
        sinks = [fanout.files("all", f"{out}/all"), fanout.Sink("flaky", flaky)]
        stream = stream_of(spark, landed)
        return runner.drain(fanout.fan_out(stream, sinks, f"{out}/status", f"{out}/cp"))

    with pytest.raises(Exception, match="flaky"):
        start()
    state["fail"] = False
    start()
    assert spark.read.parquet(f"{out}/all").count() == 200


def test_monitor_counts_equal_batch_counts(spark, landed):
    out = fresh_path(spark, "out")

    def tagged(df):
        synthetic = F.col("id") % 4 == 0
        return df.withColumns({
            "data_type": F.when(synthetic, "synthetic").otherwise("real"), "reason": F.when(synthetic, "error")})

    counts = monitor.monitor_counts(tagged(stream_of(spark, landed)), F.col("generator"), "ts")
    runner.drain(monitor.snapshots(counts, f"{out}/snap", f"{out}/cp"))
    want = monitor.monitor_counts(tagged(spark.read.parquet(landed)), F.col("generator"), "ts")
    got = monitor.current_counts(spark, f"{out}/snap")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("ttl", [None, 3600.0])
def test_buffer_keeps_the_newest_over_batches(spark, landed, ttl):
    checkpoint = fresh_path(spark, "cp")
    nulls = spark.range(500, 503).select("id", (F.col("id") % 3).alias("k"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("g0").alias("generator"))
    nulls.coalesce(1).write.mode("append").parquet(landed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buffer.ROCKSDB)
    try:
        kept = buffer.buffered(stream_of(spark, landed), "k", ["ts", "id"], ["ts", "id"], 5, 2, ttl)
        writer, deadline = buffer.keep_buffer(kept, checkpoint), time.time() + 60
        query = runner.drain(writer) if ttl is None else writer.trigger(processingTime="0 seconds").start()
        while sum(p["numInputRows"] for p in query.recentProgress) < 203 and time.time() < deadline:
            time.sleep(0.1)
        query.stop()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
        rows = buffer.latest(spark, checkpoint, "k", ["ts", "id"], 5).collect()
        assert sorted(r.id for r in rows) == list(range(185, 200))
        state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
        assert state.count() <= 3 * 2 * 5  # of three keys in two slots, however many batches
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_repair_equals_the_batch_form(spark):
    """Series with a null key, gaps across batches, repeated times and a series that starts late."""
    from driftloom.operators.fallback import fill_from_model
    from driftloom.operators.forecast import fit_ar
    from driftloom.operators.series import SeriesKey
    from driftloom.streaming import repair

    key, path = SeriesKey(("k",), "ts", ("id",)), fresh_path(spark, "repair")
    name = F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3))
    value = F.when((F.col("id") % 7 > 2) & ~F.col("id").between(85, 115), F.sin("id") * 10 + F.col("id"))
    rows = spark.range(300).select("id", name.alias("k"), F.timestamp_seconds(F.floor(F.col("id") / 6) * 60).cast("timestamp_ntz").alias("ts"), value.alias("v"))
    rows = rows.unionByName(spark.range(240, 270).select(F.col("id") + 1000, F.lit("late").alias("k"), F.timestamp_seconds(F.col("id") * 10).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.5).alias("v")).toDF("id", "k", "ts", "v"))
    rows = cut_lineage(rows)
    fit_ar(rows, key, "v").write.parquet(f"{path}/model")
    for lo, hi in ((0, 960), (960, 1800), (1800, 9999)):
        at = F.unix_seconds(F.col("ts").cast("timestamp"))
        rows.where((at >= lo) & (at < hi)).coalesce(1).write.mode("append").parquet(f"{path}/landed")
        time.sleep(0.05)
    model, emitted = spark.read.parquet(f"{path}/model"), F.col("ts")
    runner.drain(repair.repair(stream_of(spark, f"{path}/landed"), key, "v", model, emitted, path, f"{path}/cp"))
    want = fill_from_model(rows, key, "v", model, emitted)
    got = repair.repaired(spark, path).select(*want.columns)
    assert want.where("source = 'model' and k is null").count() > 0
    rounded = lambda df: sorted(map(str, df.withColumn("v", F.round("v", 6)).collect()))
    assert rounded(got) == rounded(want)


def test_committed_sink_gives_each_row_once(spark, landed):
    """A task that fails after it has written its part, and a commit that fails once: no row twice, none lost."""
    from driftloom.sinks import committed as c

    path, marks = fresh_path(spark, "sink"), fresh_path(spark, "marks")
    os.makedirs(marks)

    def once(name):
        first = not os.path.exists(f"{marks}/{name}")
        open(f"{marks}/{name}", "w").close()
        return first

    def write(batches, options):
        part = c.write_part(batches, options)
        if part.rows and once("task"):
            raise RuntimeError("the task is lost")
        return part

    def commit(parts, batch_id, options):
        if batch_id == 2 and once("commit"):
            raise RuntimeError("the driver is lost")
        c.commit_parts(parts, batch_id, options)

    def start():
        c.register_sink(spark, "flaky_parts", write, commit)
        writer = stream_of(spark, landed).writeStream.format("flaky_parts").option("path", path)
        return runner.drain(writer.option("checkpointLocation", f"{path}/cp"))

    for message in ("the task is lost", "the driver is lost"):
        with pytest.raises(Exception, match=message):
            start()
    start()
    schema = spark.read.parquet(landed).schema
    got = c.read_committed(spark, path, schema)
    assert sorted(r.id for r in got.collect()) == list(range(200))
    assert sorted(got.collect()) == sorted(spark.read.parquet(landed).collect())
    c.commit_parts([], 3, {"path": path})  # a batch that is committed again replaces itself
    assert c.read_committed(spark, path, schema).count() == 150


def test_continuous_rows_are_the_batch_rows(spark):
    """The endless source gives the ids of the batch generator, batch after batch."""
    out, seen = fresh_path(spark, "out"), []

    def emit(batch, batch_id):
        rows = batch.where("not drifted").drop("generator", "drifted").collect()
        seen.append((batch_id, batch.first().drifted, rows))

    writer = runner.continuous_generator(spark, SPEC, 20, f"{out}/cp", emit, batch_seconds=1, drift_seconds=2)
    query = writer.trigger(processingTime="0 seconds").start()
    deadline = time.time() + 60
    while len(seen) < 5 and time.time() < deadline and query.isActive:
        time.sleep(0.1)
    query.stop()
    assert [b for b, _, _ in seen[:5]] == [0, 1, 2, 3, 4]
    assert [drifted for _, drifted, _ in seen[:5]] == [False, False, True, False, True]
    batch = generate(row_ids(spark, 20, 20), SPEC, keep=["row_id"]).collect()
    assert sorted(seen[1][2]) == sorted(batch)


def test_run_for_emits_several_batches_and_stops(spark):
    out, seen = fresh_path(spark, "out"), []
    spec = TableSpec.of("series", PRESET_SERIES)
    emit = lambda batch, batch_id: seen.append(batch.count())
    query = runner.run_for(runner.continuous_generator(spark, spec, 10, f"{out}/cp", emit), 6, 0.1)
    assert not query.isActive and len(seen) > 1 and set(seen) == {10}


def test_drift_event_schedule():
    events = [runner.drift_event(b, 1.0, 3.0) for b in range(8)]
    assert events == [None, None, None, 1, None, None, 2, None]
    assert runner.drift_event(4, 1.0, 0.25) == 4
    assert [7 * b for b in range(1, 9) if runner.drift_event(b, 7.0, 10.0)] == [14, 28, 42, 56]


def test_continuous_source_schema(spark):
    assert continuous_rows(spark, 10).columns == ["row_id"]


def test_progress_metrics(spark):
    rows = [("a", 0, 100, 2.0, 50.0), ("a", 1, 300, 1.0, 300.0), ("b", 0, 5, 0.5, 10.0)]
    df = spark.createDataFrame(rows, monitor.METRIC_SCHEMA)
    got = {r.label: (r.batches, r.records, r.seconds) for r in monitor.metrics(df).collect()}
    assert got == {"a": (2, 400, 3.0), "b": (1, 5, 0.5)}


def events_folder(spark, n):
    path = fresh_path(spark, "events")
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(f"{path}/events.parquet")
    return path


def test_stream_continuous_waits_for_all_ids(spark, monkeypatch):
    """However long it takes: here every look at the clock is an hour after the last one."""
    clock = iter(range(0, 10**9, 3600))
    monkeypatch.setattr(streams.time, "time", lambda: next(clock))
    ids = [r.event_id for r in streams.stream_continuous(spark, events_folder(spark, 2500)).select("event_id").collect()]
    assert sorted(ids) == list(range(2500))


def test_stream_continuous_raises_what_failed(spark, monkeypatch):
    def fails_late(spark, spec, size, checkpoint, emit):
        def some(batch, batch_id):
            if batch_id > 1:
                raise RuntimeError("the disk is full")
            emit(batch, batch_id)

        return made(spark, spec, size, checkpoint, some)

    made = runner.continuous_generator
    monkeypatch.setattr(streams.runner, "continuous_generator", fails_late)
    with pytest.raises(Exception, match="the disk is full"):
        streams.stream_continuous(spark, events_folder(spark, 5000)).count()


def test_stream_continuous_of_no_events(spark):
    none, some = (streams.stream_continuous(spark, events_folder(spark, n)) for n in (0, 3))
    assert none.count() == 0 and none.dtypes == some.dtypes
