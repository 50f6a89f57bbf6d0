import json
import os
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.session import cut_lineage, fresh_path, shared_root
from driftloom.sinks import writers
from driftloom.sources import history as h
from driftloom.sources import payloads as p
from driftloom.sources.custom import register_source

MAP = {
    "Meta Data": {"1. Information": "Intraday"},
    "Time Series (5min)": {
        "2024-01-02 10:00:00": {"1. open": "1.4", "2. high": "x", "close": "2", "5. volume": "10"},
        "2024-01-02 10:05:00": {"1. open": "1.5"},
    },
    "Time Series (old)": {"2020-01-01": {"1. open": "9"}},
}
ARRAYS = {
    "chart": {
        "result": [
            {
                "timestamp": [1704190000, 1704190060],
                "indicators": {"quote": [{"open": [1.0, None], "high": [2.0, 3.0], "low": [0.5, 0.6],
                                          "close": [1.5, 1.6], "volume": [10, 20]}]},
            }
        ]
    }
}
RECORDS = {"Response": "Success", "Data": [{"time": 1704190000, "open": 1.0, "close": 2}]}


def frame(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "id int, payload string")


def test_map_payload(spark):
    rows = p.map_payload(frame(spark, MAP), "payload", ["id"]).orderBy("ts").collect()
    assert [(r.open, r.high, r.close, r.volume) for r in rows] == [(1.4, None, 2.0, 10.0), (1.5, None, None, None)]
    assert rows[0].ts == datetime(2024, 1, 2, 10)


def test_array_payload(spark):
    bodies = frame(spark, ARRAYS, {"chart": {"result": []}})
    rows = p.array_payload(bodies, "payload", ["id"]).orderBy("ts").collect()
    assert [(r.id, r.open, r.volume) for r in rows] == [(0, 1.0, 10.0), (0, None, 20.0)]
    assert rows[0].ts == datetime(2024, 1, 2, 10, 6, 40)


def test_record_payload(spark):
    rows = p.record_payload(frame(spark, RECORDS, {"Data": []}), "payload", ["id"]).collect()
    assert [(r.id, r.open, r.high, r.close) for r in rows] == [(0, 1.0, None, 2.0)]


def test_split(spark):
    note = "standard API call frequency is 5 calls"
    bodies = frame(
        spark, MAP, ARRAYS, RECORDS, {"Error Message": "x"}, {"Note": note}, {**MAP, "Note": note},
        {"Response": "Error"}, {"chart": {"result": []}}, {"Data": []}, "{nope",
    )
    good, bad = p.split(bodies, "payload")
    assert {r.id: r.shape for r in good.collect()} == {0: "map", 1: "arrays", 2: "records", 5: "map"}
    assert {r.id: r.reason for r in bad.collect()} == {
        3: "error", 4: "rate_limited", 6: "error", 7: "empty", 8: "empty", 9: "malformed",
    }


def test_payload_is_parsed_once(spark):
    plan = p.array_payload(frame(spark, ARRAYS), "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan


def test_between_includes_both_ends_and_is_pushed_down(spark):
    path = fresh_path(spark, "range")
    stamp = F.timestamp_add("DAY", "id", F.lit("2024-01-01").cast("timestamp_ntz"))
    spark.range(10).select("id", stamp.alias("ts")).write.parquet(path)
    kept = h.between(h.read_history(spark, path), "ts", "2024-01-03", "2024-01-05")
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert "GreaterThanOrEqual(ts" in kept._jdf.queryExecution().executedPlan().toString()
    assert h.between(h.read_history(spark, path), "ts", "2024-01-09").count() == 2


@pytest.mark.parametrize(
    "kind, days, seconds",
    [("map", 5, 300), ("map", 6, 86400), ("map", 101, 604800), ("arrays", 5, 300), ("arrays", 30, 1800),
     ("arrays", 90, 3600), ("arrays", 365, 86400), ("arrays", 366, 604800), ("records", 3, 60),
     ("records", 30, 3600), ("records", 31, 86400)],
)
def test_bar_width_by_span(spark, kind, days, seconds):
    assert spark.range(1).select(h.bar_seconds(kind, F.lit(days))).first()[0] == seconds


def doubles():
    """A source of numbers and their doubles; a nested function travels to the workers by value."""

    def fetch(lo, hi, options):
        ids = list(range(lo, hi))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "twice": pa.array([2 * i for i in ids], pa.int64())})

    return fetch


def test_custom_source(spark):
    register_source(spark, "doubles", "id bigint, twice bigint", doubles(), "id", lambda options: 1000)
    read = spark.read.format("doubles").option("sliceRows", "300").option("batchRows", "7")
    df = read.load()
    assert df.rdd.getNumPartitions() == 4
    assert df.agg(F.sum("twice")).first()[0] == 999 * 1000 and df.count() == 1000
    assert sorted(r.id for r in read.option("last", "3").load().collect()) == [997, 998, 999]
    assert spark.read.format("doubles").option("end", "0").load().count() == 0


@pytest.mark.parametrize("condition, ids", [
    ("id >= 10 and id < 13", [10, 11, 12]), ("id > 997", [998, 999]), ("id <= 1", [0, 1]), ("id = 5", [5]),
    ("id between 7 and 8 and twice > 14", [8]), ("id > 5 and id < 5", []), ("id in (3, 4)", [3, 4]), ("id is null", []),
])
def test_custom_source_filters_narrow_the_slices(spark, condition, ids):
    fetched = fresh_path(spark, "fetched")
    os.makedirs(fetched)
    fetch = doubles()

    def watched(lo, hi, options):
        open(f"{fetched}/{lo}-{hi}", "w").close()
        yield from fetch(lo, hi, options)

    register_source(spark, "watched", "id bigint, twice bigint", watched, "id", lambda options: 1000)
    df = spark.read.format("watched").option("sliceRows", "100").load().where(condition)
    assert sorted(r.id for r in df.collect()) == ids
    if "twice" not in condition and " in " not in condition and "null" not in condition:
        ranges = [tuple(map(int, f.split("-"))) for f in os.listdir(fetched)]
        assert sum(hi - lo for lo, hi in ranges) == len(ids)  # nothing else was fetched


def test_custom_source_streams_by_offsets(spark):
    """A stream goes on where it ended, and reads only what has come since."""
    state, out = {"end": 250}, fresh_path(spark, "offsets")
    newest = f"{out}/newest"
    os.makedirs(out)

    def latest(options):
        with open(newest) as f:
            return int(f.read())

    register_source(spark, "growing", "id bigint, twice bigint", doubles(), "id", latest)
    for state["end"] in (250, 250, 400):
        with open(newest, "w") as f:
            f.write(str(state["end"]))
        stream = spark.readStream.format("growing").option("sliceRows", "100").load()
        writer = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp")
        writer.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(state["end"]))


def test_map_payload_odd_shapes(spark):
    """Points that are no objects, nulls, double names and texts that are no JSON."""
    key = "Time Series (1min)"
    bodies = frame(
        spark, {key: {"2024-01-01": 5, "2024-01-02": {"1. open": 2, "1. high": None}}}, {key: None}, {key: [1]}, [1], "", "{nope",
        '{"a": 1, "a": 2}', {key: {"x": {"1. open": "3"}}},
    ).union(spark.createDataFrame([(99, None)], "id int, payload string"))
    rows = p.map_payload(bodies, "payload", ["id"], ["open", "high"]).collect()
    assert sorted((r.id, r.ts and r.ts.day, r.open, r.high) for r in rows if r.id == 0) == [(0, 1, None, None), (0, 2, 2.0, None)]
    assert [(r.id, r.ts, r.open) for r in rows if r.id != 0] == [(7, None, 3.0)]
    shapes = {r.id: (r["shape"], r.reason) for r in p.classified(bodies, "payload").collect()}
    assert shapes == {0: ("map", None), 1: (None, "empty"), 2: ("map", None), 7: ("map", None), **{i: (None, "malformed") for i in (3, 4, 5, 6, 99)}}


# --- sinks -------------------------------------------------------------------


def batch(spark, *rows):
    return spark.createDataFrame(rows, "id bigint, value double, category string")


def test_csv_write_and_append(spark):
    path = fresh_path(spark, "csv")
    writers.write_files(batch(spark, (1, 10.0, "A"), (2, 20.0, "B")), path)
    writers.write_files(batch(spark, (3, 30.0, "C"), (4, 40.0, "D")), path)
    got = spark.read.option("header", True).schema("id bigint, value double, category string").csv(path)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]
    writers.write_files(batch(spark, (9, 1.0, "Z")), path, mode="overwrite")
    assert spark.read.option("header", True).csv(path).count() == 1


def test_json_keeps_nulls_and_spaces_times(spark):
    path = fresh_path(spark, "json")
    df = batch(spark, (1, None, "A")).withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    writers.write_files(df, path, "json")
    line = json.loads(spark.read.text(path).first()[0])
    assert line["value"] is None and line["ts"].startswith("2024-01-02 03:04:05")


def test_files_partitioned_by_generator(spark):
    path = fresh_path(spark, "parts")
    df = batch(spark, (1, 1.0, "A")).withColumn("generator", F.lit("g1"))
    writers.write_files(df, path, "parquet", partition_by=["generator"])
    assert spark.read.parquet(f"{path}/generator=g1").count() == 1


def test_bad_format_and_mode(spark):
    with pytest.raises(ValueError, match="unsupported format"):
        writers.write_files(batch(spark), "/nowhere", "xml")
    with pytest.raises(ValueError, match="unsupported mode"):
        writers.write_files(batch(spark), "/nowhere", "csv", "upsert")


def test_console(spark, capsys):
    writers.show(batch(spark, (1, 10.0, "A")), "out")
    writers.show(batch(spark, (1, 10.0, "A")), "out", pretty=False)
    printed = capsys.readouterr().out
    assert "--- out ---" in printed and "'category': 'A'" in printed
    assert '{"id":1,"value":10.0,"category":"A"}' in printed


def test_kafka_payload(spark):
    row = writers.kafka_payload(batch(spark, (1, None, "A"))).first()
    assert json.loads(row.value) == {"id": 1, "value": None, "category": "A"}


def test_sample_is_repeatable(spark):
    rows = [writers.sample(spark.range(0, 1000, 1, n), 0.2, 1, "id") for n in (1, 5)]
    first, second = (sorted(r.id for r in x.collect()) for x in rows)
    assert first == second and 150 < len(first) < 250


def test_scratch_follows_the_session(spark):
    assert fresh_path(spark, "x").startswith(shared_root(spark) + "/")
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
