import math

import numpy as np
import pytest

from driftloom.llm import vector_search
from driftloom.llm.vector_search import best_of_block, segment_statistics, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, row string"


def brute(rows, k=5):
    ok = [(n, i, [math.floor(256 * float(np.float32(c))) for c in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in ok if m != n)[:k]  # noqa: B905
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, lambda key: key % 50 == 0).collect()), key=str)


def test_bounds_never_cut_a_product():
    draw = np.random.default_rng(0)
    a, b = draw.normal(0, 30, (50, 37)), draw.normal(0, 30, (70, 37))
    for n in vector_search.LEVELS:
        assert (segment_statistics(a, n) @ segment_statistics(b, n).T + 1e-6 >= a @ b.T).all()


def test_blocks_find_the_best_with_ties():
    draw = np.random.default_rng(1)
    q, c = np.floor(draw.normal(0, 4, (30, 8))), np.floor(draw.normal(0, 4, (900, 8)))
    c[500:700] = c[3]  # many equal scores
    rank = draw.permutation(900)
    i, j, score = best_of_block(q, np.arange(30), c, np.arange(100, 1000), rank, 5)
    for n in range(30):
        want = sorted(((-int(s), int(r), m) for m, (s, r) in enumerate(zip(c @ q[n], rank, strict=True))))[:5]
        assert [(-int(s), m) for s, m in zip(score[i == n], j[i == n], strict=True)] == [(s, m) for s, _, m in want]


@pytest.mark.parametrize("block", [8192, 40])
def test_whole_table(spark, monkeypatch, block):
    draw = np.random.default_rng(2)
    rows = [(int(n), [float(x) for x in draw.normal(0, 1, 12)], "s", "r") for n in draw.permutation(300)]
    rows += [(1000 + n, rows[5][1], "s", "r") for n in range(60)]  # one large group of copies
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, lambda key: key % 50 == 0, block=block).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], "", ""), (50, [0.5, -1.0], "", ""), (50, [0.5, -1.0], "", ""), (1, None, "", ""), (2, [1.0, None], "", ""), (100, [nan, 1.0], "", ""),
        (3, [inf, 1.0], "", ""), (None, [3.0, 3.0], "", ""), (4, [], "", ""), (5, [1.0], "", ""), (6, [1e30, 1.0], "", ""), (7, [0.1, 0.2], "", ""),
    ]
    got = found(spark.createDataFrame(rows, SCHEMA))
    plain = [r for r in rows if r[0] != 6]
    assert [r for r in found(spark.createDataFrame(plain, SCHEMA))] == brute(plain)
    assert (0, 1, 6, (1 << 63) - 1) in got
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(50, [1.0], "", "")], SCHEMA)) == []
