import numpy as np
import pytest

from driftloom.llm import quality
from driftloom.llm.quality import fit, keep_good, scored, statistics


@pytest.fixture(scope="module")
def graded(spark):
    draw = np.random.default_rng(1)
    words = "plain words of an ordinary sentence that goes on and ends".split()
    rows = []
    for i in range(400):
        body = [words[j] for j in draw.integers(0, len(words), int(draw.integers(5, 200)))]
        good = i % 4 != 0
        rows.append((i, " ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body), int(good), "kept as it is"))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, _key string").repartition(3)


def test_held_out_accuracy(graded):
    model = fit(graded.select("doc_id", "text", "_key"), graded.where("doc_id % 5 <> 0").select("doc_id", "quality"))
    found = {r.doc_id: r.score for r in scored(graded, model).collect()}
    held = [(found[r.doc_id] >= 0.3) == bool(r.quality) for r in graded.where("doc_id % 5 = 0").collect()]
    assert np.mean(held) > 0.97 and all(0 <= s <= 1 for s in found.values())
    kept = keep_good(graded, model)
    assert kept.columns == graded.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in found.items() if s >= 0.3)


def test_normal_equations_are_summed_over_partitions(graded):
    """One and many partitions give the same weights."""
    labels = graded.select("doc_id", "quality")
    one, many = fit(graded.coalesce(1), labels), fit(graded.repartition(11), labels)
    assert np.allclose(one.weights, many.weights, atol=1e-6) and np.allclose(one.mean, many.mean)


def test_isotonic_pools():
    n, y = np.zeros(quality.BINS), np.zeros(quality.BINS)
    n[100:105], y[100:105] = 10, [1, 5, 3, 3, 9]
    at, value = quality._isotonic(n, y)
    assert len(at) == 3 and np.allclose(value, [0.1, 11 / 30, 0.9]) and np.all(np.diff(value) >= 0)


def test_awkward_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = fit(docs, none)
    assert [r.score for r in scored(docs, model).collect()] == [0.5] * docs.count()
    assert keep_good(docs, model).count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (9, None), (6, 1), (999, 0)], "doc_id long, quality int")
    model = fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in scored(docs, model).collect())
    assert scored(no_docs, model).count() == 0 and keep_good(no_docs, model).count() == 0 and fit(no_docs, labels).score(np.zeros((1, quality.WIDE)))[0] == 0.5


@pytest.mark.parametrize("text", [b"", b" ", b"x", b"\xc3\xa9" * 1000, b"word " * 50_000])
def test_statistics_are_finite(text):
    x = statistics(text)
    assert x.shape == (quality.WIDE,) and np.isfinite(x).all()
