"""The drift schedule, in one range and in several, against a walk over the batches."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators.drift import _steps, drift_epochs

START = datetime(2024, 1, 1)


def walked(starts, interval):
    """Times of the drifting batches: a drift resets the clock."""
    last, out = 0, []
    for t in sorted(starts):
        if t - last >= interval:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("fold", [20_000, 9])
@pytest.mark.parametrize("shape", ["even", "irregular", "gaps"])
def test_a_drift_resets_the_interval(spark, fold, shape):
    draw = np.random.default_rng(3)
    gaps = {"even": [7] * 60, "irregular": draw.integers(0, 9, 80), "gaps": draw.choice([1, 2, 90], 60)}[shape]
    times = [int(x) for x in np.cumsum(gaps)]
    rows = [(i, START + timedelta(seconds=t + late)) for i, t in enumerate(times) for late in (0, 0)]
    df = spark.createDataFrame(rows, "batch bigint, ts timestamp_ntz").repartition(3)
    origin = F.lit(int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    got = drift_epochs(df, "ts", "batch", origin, 10.0, fold).orderBy("drift_ts").collect()
    assert [(r.drift_ts - START).seconds for r in got] == walked(times, 10)
    first = {t: i for i, t in reversed(list(enumerate(times)))}
    assert [r.batch for r in got] == [first[(r.drift_ts - START).seconds] for r in got] and len({r.epoch for r in got}) == len(got)


def test_step_functions_follow_one_another():
    """Whatever drift enters a range, the function gives the last one of a walk through it."""
    draw = np.random.default_rng(4)
    for _ in range(50):
        t = np.unique(draw.integers(100, 100 + int(draw.integers(5, 400)), int(draw.integers(1, 60))))
        upto, last = _steps(t, 10)
        assert len(upto) <= 11
        for entering in range(60, int(t[0])):
            at = entering
            for x in t.tolist():
                at = x if x >= at + 10 else at
            i = int(np.searchsorted(upto, entering))
            assert (int(last[i]) if i < len(upto) else entering) == at


def test_no_batch_and_times_before_the_start(spark):
    origin = F.lit(int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    for rows in ([], [(1, START - timedelta(seconds=50)), (2, START)]):
        df = spark.createDataFrame(rows, "batch bigint, ts timestamp_ntz")
        assert drift_epochs(df, "ts", "batch", origin, 10.0).count() == 0
