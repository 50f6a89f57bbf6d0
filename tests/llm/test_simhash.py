import numpy as np
import pytest
import xxhash

from driftloom.llm.simhash import components, drop_near, fingerprint, linked, links, near_components, node_masks


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(prints, bits=4, cells=None):
    """Smallest index of each brute-force component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    if cells is not None:
        near &= cells[:, None] == cells[None, :]
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(draw, centres, most, flips):
    out = []
    for c in draw.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(int(draw.integers(1, most))):
            out.append(int(c) ^ sum({1 << int(b) for b in draw.integers(0, 64, int(draw.integers(0, flips)))}))
    return np.array(out, np.uint64)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", ["", "one", "one two three four", "one two three four five", "A b  C\td e f g " * 300, "é " * 500])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("room", [1 << 20, 3000])
def test_index_finds_all_links_of_every_cell(room):
    draw = np.random.default_rng(5)
    prints = clustered(draw, 40, 120, 8)
    cells = draw.integers(-3, 3, len(prints))
    assert same_partition(linked(cells, prints, 4, room).tolist(), parts(prints, 4, cells))


def test_every_pair_within_reach_meets_in_a_node():
    masks = node_masks(4, 6)
    draw = np.random.default_rng(2)
    for _ in range(500):
        flips = sum({1 << int(b) for b in draw.integers(0, 64, 4)})
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("cell", [4096, 8])
def test_components_of_links(spark, cell):
    """With cells of eight, nodes are dealt into parts and every two parts still meet."""
    prints = np.unique(clustered(np.random.default_rng(9), 12, 60, 7))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    from driftloom.llm.common import written
    roots = {r.a: r.root for r in components(links(written(frame), 4, cell)).collect()}
    got = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert same_partition(got, parts(prints))


def test_near_components_agree_with_brute_force(docs):
    rows = docs.collect()
    prints = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    root, least = parts(prints), {}
    for r, p in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[p] = min(least.get(p, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), int(x), str(least.get(p))) for r, x, p in zip(rows, prints.view(np.int64), root, strict=True))
    assert sorted((str(r.doc_id), r.fp, str(r.component)) for r in near_components(docs).collect()) == expected
    kept = drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(least.get(p)) for p in root})


def test_empty(no_docs):
    assert near_components(no_docs).count() == 0 and drop_near(no_docs).count() == 0
