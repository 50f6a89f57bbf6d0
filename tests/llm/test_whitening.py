import math

import numpy as np
import pytest

from driftloom.llm import whitening
from driftloom.llm.whitening import LONG, fit, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n long, key string, x int"


def numbers(rows):
    wide = max((len(v) for _, v, *_ in rows if v is not None), default=0)
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (wide - len(v))) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return ok


def brute(rows):
    """Exact integer covariance, then symmetric eigenvectors."""
    ok = numbers(rows)
    distinct = [list(x) for x in {tuple(x) for _, x in ok}]
    n = len(distinct)
    sums = [sum(v) for v in zip(*distinct, strict=True)]
    y = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in distinct], dtype=object)
    v = np.array((y.T @ y), dtype=float) / float(n) ** 3
    e, u = np.linalg.eigh(v)
    return ok, n, sums, e[::-1], u[:, ::-1], float(np.trace(v))


def compare(frame, rows, most=4):
    got = whiten(frame).collect()
    ok, n, sums, e, u, trace = brute(rows)
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == len(ok) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in ok:
        dev = min(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), LONG)
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        for c in range(1, k + 1):
            want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
            for r in by[(i, c)]:
                assert r.n == n and r.explained == pytest.approx(e[c - 1] / trace, rel=1e-9) and r.identity_error < 1e-4
                assert r.deviation == dev or len(by[(i, c)]) > 1
                if len(by[(i, c)]) == 1:
                    if abs(want) > 1e-3:
                        assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
                    assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_eigenvectors_of_the_exact_covariance(spark, parts):
    draw = np.random.default_rng(0)
    mix = draw.normal(0, 1, (9, 9)) * np.array([5, 3, 2, 1.5, 1, 0.5, 0.3, 0.2, 0.1])
    rows = [(i, [float(v) for v in draw.normal(0.7, 1, 9) @ mix], 1, 2, "k", 3) for i in range(300)]
    rows += [(1000 + i, rows[4][1], 1, 2, "k", 3) for i in range(200)]  # copies count once in the fit
    compare(spark.createDataFrame(rows, SCHEMA).repartition(parts), rows)


def test_far_from_zero_and_badly_conditioned(spark):
    draw = np.random.default_rng(1)
    scales = np.array([300.0, 40.0, 3.0, 0.5, 0.02])
    rows = [(i, [float(v) for v in 5000 + draw.normal(0, 1, 5) * scales], 1, 2, "k", 3) for i in range(400)]
    compare(spark.createDataFrame(rows, SCHEMA), rows)


def test_deficient_rows(spark):
    """Constant and dependent dimensions, fewer vectors than dimensions: only components that vary return."""
    draw = np.random.default_rng(2)
    two = [(i, [3.0, float(a), float(2 * a), float(b), 0.0], 1, 2, "k", 3) for i, (a, b) in enumerate(draw.integers(-50, 50, (60, 2)))]
    compare(spark.createDataFrame(two, SCHEMA), two)
    three = [(i, [float(v) for v in draw.normal(0, 1, 12)], 1, 2, "k", 3) for i in range(3)]
    compare(spark.createDataFrame(three, SCHEMA), three)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [2.0, -1.0, 0.5], [1.0, 2.0, 3.0], None, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [], [1.5], [-0.0, 0.001, -0.001]]
    rows = [(i, v, 9, 9, "k", 9) for i, v in enumerate(vectors)] + [(None, [4.0, 4.0, 1.0], 9, 9, "k", 9)]
    compare(spark.createDataFrame(rows, SCHEMA), rows)
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame(rows[:1] + rows[2:3], SCHEMA)).collect() == []  # one distinct vector
    assert whiten(spark.createDataFrame([rows[3], rows[7]], SCHEMA)).collect() == []
    huge = rows[:2] + [(5, [1e30, 1.0, 1.0], 9, 9, "k", 9)]
    assert {r.deviation for r in whiten(spark.createDataFrame(huge, SCHEMA)).collect()} == {LONG}


def test_passes_orthogonalise(spark):
    """One shifted pass is not enough for a bad condition number, the further ones are."""
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(0, 1, (500, 6)) * np.array([1e9, 1e7, 1e4, 100, 30, 10])).astype(np.int64)
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>")
    model = fit(frame, 6, 6)
    assert 2 <= len(model.factors) <= whitening.PASSES and model.identity_error < 1e-8
    q = model.orthogonal(x)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-11
