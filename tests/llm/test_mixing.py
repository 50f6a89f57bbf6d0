from collections import defaultdict

import pytest

from driftloom.llm.mixing import apply_mix, mixed


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * left / w > most * sizes[s]} if w else set()
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * left / w for s in order}
        capped |= over


@pytest.fixture(scope="module")
def sized(spark):
    rows, n = [], 0
    for source, count in (("a", 300), ("b", 120), ("c", 500), ("d", 40), (None, 200), ("é", 90)):
        for i in range(count):
            n += 1
            rows.append((n, "w " * (1 + (i * 7919 + n) % 97), source, "extra"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _s string").repartition(3)


def test_targets_are_met(sized):
    got = mixed(sized).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 2 and 0 <= r.rate <= 2 and abs(r.copies - r.rate) <= 1
    want = expected_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5


def test_rates_are_exponential_tilts(sized):
    """Where no rate reaches the limit, log rate is proportional to size within a source."""
    import math
    for r in mixed(sized).where("source = 'c'").collect():
        if r.rate < 2:
            slope = math.log(r.rate) / r["size"]
            first = locals().setdefault("seen", slope)
            assert slope == pytest.approx(first, rel=1e-6)


def test_reruns_agree(sized):
    one = {(r.doc_id, r.copies) for r in mixed(sized).collect()}
    assert one == {(r.doc_id, r.copies) for r in mixed(sized.repartition(7)).collect()}


def test_apply_mix_repeats_rows(sized):
    copies = {r.doc_id: r.copies for r in mixed(sized).collect()}
    got = defaultdict(int)
    out = apply_mix(sized)
    assert out.columns == sized.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {i: c for i, c in copies.items() if c}


def test_awkward_rows(docs, no_docs):
    got = mixed(docs).collect()
    assert len(got) == docs.count()
    assert all(r.copies == 1 for r in got if r["size"] == 0)
    assert apply_mix(docs).columns == docs.columns
    assert mixed(no_docs).count() == 0 and apply_mix(no_docs).count() == 0
