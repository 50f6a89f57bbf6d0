import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from driftloom.llm.va_clusters import HELD, Cells, clusters, intervals, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster string, key string, row long, x int, code string"


def brute(rows, dimensions, k, rounds):
    """The contract in plain Python."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-HELD, min(HELD, math.floor(1024 * float(np.float32(c))))) for c in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, at) in zip(kept, found, strict=True) if at == n]
            if mine:
                centroids[n] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    found = assign()
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    return Counter((i, n, d, min(inertia[n], 2**63 - 1), min(sum(inertia.values()), 2**63 - 1), tuple(centroids[n])) for (i, _), (d, n) in zip(kept, found, strict=True))


def found(frame, **settings):
    out = clusters(frame, **settings)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out.collect())


def test_intervals_never_lose_the_nearest():
    draw = np.random.default_rng(0)
    x = draw.normal(0, 300, (2000, 7)).astype(np.int64)
    x[:5] *= 1000
    marks = [np.unique(np.quantile(x[:, d], np.linspace(0.1, 0.9, 15)).astype(np.int64)) for d in range(7)]
    cells = Cells(x.min(0), x.max(0), marks, 4)
    centroids = x[draw.choice(len(x), 6, replace=False)]
    centroids[5] = centroids[2]  # a tie everywhere
    can = intervals(cells.codes(x), cells.tables(centroids))
    number, _ = nearest(x, centroids)
    assert can[np.arange(len(x)), number].all()
    assert (can.sum(1) == 1).any() and (can.sum(1) > 1).any()
    assert (nearest(x, centroids, can)[0] == number).all()


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("bits", [8, 3])
def test_equals_brute_force(spark, parts, bits):
    draw = np.random.default_rng(1)
    middles = draw.normal(0, 1, (6, 5))
    rows = [(int(i), [float(v) for v in draw.normal(middles[i % 6], 0.4)], "c", "k", 1, 2, "z") for i in range(400)]
    rows += [(1000 + n, rows[7][1], "c", "k", 1, 2, "z") for n in range(150)]  # a large group of copies
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert found(frame, dimensions=5, bits=bits) == brute(rows, 5, 8, 10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], [-0.5, 0.25], None, [], [1.0], [1.0, None], [nan, 0.0], [0.0, inf], [1e30, -1e30], [3.0, -4.0], [0.1, 0.2, 0.3]]
    rows = [(i, v, "c", None, 1, 2, "z") for i, v in enumerate(vectors)] + [(1, [9.0, 9.0], "", "", 0, 0, ""), (None, [2.0, 2.0], "", "", 0, 0, ""), (None, [2.5, 2.0], "", "", 0, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, dimensions=2, clusters=3) == brute(rows, 2, 3, 10)
    assert found(frame, dimensions=2) == brute(rows, 2, 8, 10)
    few = spark.createDataFrame(rows[:2], SCHEMA)
    assert found(few, dimensions=2) == brute(rows[:2], 2, 8, 10)  # fewer vectors than centroids, and all equal
    assert found(frame, dimensions=9) == Counter()
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()


def test_fetch_moves_row_numbers_only(spark):
    """A round reads the approximations alone and shuffles no vectors."""
    from driftloom.llm.va_clusters import VaFile, whole_numbers

    draw = np.random.default_rng(2)
    rows = [(i, [float(v) for v in draw.normal(0, 1, 4)], "", "", 0, 0, "") for i in range(200)]
    file = VaFile(whole_numbers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 4))
    old = file.first_centroids(4, file.rows.row)
    plan = file.open_rows(old, old + 1)._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "code" in scan.split("ReadSchema")[1] and "x:array" not in scan.split("ReadSchema")[1].replace(" ", "")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = file.open_rows(old, old + 1).join(file.rows, "row").select("code", "x")
        exchanges = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(exchanges) == 1  # the row numbers; the vectors stay in their buckets
    file.forget()
