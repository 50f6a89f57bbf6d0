import pickle
import zlib
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import lm_scoring
from driftloom.llm.lm_scoring import CLASSES, Reader, Vocabulary, ending_class, feature_slots, head_of, lm_scores, log_classes, positions, step


def base_scores(texts, learned):
    count = Counter(w for t in learned for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    out = []
    for t in texts:
        words = [*(t or "").encode().lower().split(), b""]
        out.append((len(words), sum(count[w] > 0 for w in words), n, sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


@pytest.mark.parametrize("head", [1 << 16, 5])
def test_counts_and_base_scores(docs, head):
    """With a table of five tokens nearly every count comes from the join."""
    rows = docs.collect()
    training = docs.where("doc_id is null or doc_id <> 8")
    want = sorted(base_scores([r.text for r in rows], [r.text for r in training.collect()]))
    got = lm_scores(docs, training, rounds=1, head=head).collect()
    assert np.allclose(sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), want, rtol=1e-9)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_empty(docs, no_docs):
    assert lm_scores(no_docs, docs, rounds=1).count() == 0
    got = lm_scores(docs, no_docs, rounds=1).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) and np.isclose(r.base_score, 0) for r in got)


def test_learns_more_than_token_counts(spark):
    draw = np.random.default_rng(3)
    tongues = [[f"{a}{b}{e}" for a in "bdfg" for b in "aeiou"] for e in ("tion", "sch", "ez", "ino")]
    rows = [(i, " ".join(tongues[i % 4][j] for j in draw.integers(0, 20, 120))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm_scores(docs, docs.where("doc_id % 5 <> 1")).where("doc_id % 5 = 1").collect()
    assert np.mean([r.score - r.base_score for r in got]) > 5 and np.mean([r.score > r.base_score for r in got]) > 0.95


def test_the_class_factor_is_a_distribution_and_steps_lower_the_loss():
    draw = np.random.default_rng(1)
    kind, hashes = draw.integers(0, CLASSES, 500).astype(np.int32), draw.integers(0, 9, 500).astype(np.uint32)
    slots = feature_slots(kind, hashes)
    weights, square, bias = np.zeros((lm_scoring.SLOTS, CLASSES), np.float32), np.ones(lm_scoring.SLOTS, np.float32), np.zeros(CLASSES, np.float32)

    def loss():
        p = log_classes(weights, bias, slots)
        assert np.allclose(np.exp(p).sum(1), 1, atol=1e-4)
        return -p[np.arange(500), kind].mean()

    before = loss()
    for _ in range(20):
        step(weights, square, bias, slots, kind)
    assert loss() < before - 0.5


def test_texts_do_not_look_across_their_ends():
    """Features of a text are the same alone and after others."""
    vocabulary = Vocabulary({})
    texts = [b"a b c d", b"", b"c d e"]
    reader = Reader(vocabulary)
    together = positions(reader, reader.read(texts)[0])[1]
    alone = []
    for t in texts:
        other = Reader(vocabulary)
        alone.append(positions(other, other.read([t])[0])[1])
    assert (together == np.concatenate(alone, axis=1)).all()


def test_head_is_the_most_frequent(spark):
    counts = spark.createDataFrame([(bytearray(w.encode()), c) for w, c in [("b", 3), ("a", 3), ("c", 9), ("d", 1)]], "token binary, c long")
    entry = head_of(counts, 3).entry
    assert list(entry) == [b"c", b"a", b"b"] and entry[b"c"] == (0, 9) and head_of(counts, 3).of(b"zz") == (ending_class(b"zz"), -1)


def test_features_tell_tokens_of_a_class_apart(spark):
    """Every second word follows from the one before it, and frequent words of a class are many."""
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(f"x{j} y{j}" for j in draw.integers(0, 500, 100))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm_scores(docs, docs.where("doc_id % 5 <> 1")).where("doc_id % 5 = 1").collect()
    # counts within a class, without features, gave 0.46
    assert np.mean([(r.score - r.base_score) / r.n_tokens for r in got]) > 0.8


def small_tree():
    words = [f"{a}{b}{e}".encode() for a in "bdfg" for b in "aeiou" for e in ("tion", "sch", "ez", "ino")]
    vocabulary = Vocabulary({w: (ending_class(w) if i > 30 else i % 16, 90 - i) for i, w in enumerate(words)})
    shape = lm_scoring.ENDINGS, 4
    return words, vocabulary, lm_scoring.tree_of(vocabulary, np.arange(64.0).reshape(shape), np.full(shape, 3))


def test_leaves_of_a_class_are_a_distribution():
    words, vocabulary, tree = small_tree()
    weights = np.random.default_rng(1).normal(size=1 << 12).astype(np.float32)
    kinds = np.repeat(np.arange(lm_scoring.ENDINGS), 4) + lm_scoring.OWN + lm_scoring.SHARED
    kinds = np.concatenate([[vocabulary.of(w)[0] for w in words], kinds])
    leaves = np.concatenate([[tree.place[w] for w in words], (np.array(tree.shared)[:, None] + np.arange(4)).ravel()])
    assert sorted(leaves) == list(range(len(tree.room)))
    for weights, by_counts in ((weights, False), (0 * weights, True)):
        p = np.exp(lm_scoring.log_leaves(weights, tree, leaves, np.tile(np.arange(4, dtype=np.uint32)[:, None], len(leaves))))
        assert np.allclose(np.bincount(kinds, p)[np.unique(kinds)], 1, atol=1e-4)
        if by_counts:
            room = np.exp(tree.room[leaves])
            assert np.allclose(p, room / np.bincount(kinds, room)[kinds], rtol=1e-4)


def test_shared_leaves_and_slots_grow_with_the_vocabulary(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{j}" for j in draw.integers(0, 1 << 14, 300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, tree, of_class, of_branch = lm_scoring.model_of(docs, head=50)[2]
    assert len(vocabulary.entry) <= 50 and tree.bits == 3 and len(tree.room) == len(vocabulary.entry) + 8 * lm_scoring.ENDINGS
    assert of_class.shape == (lm_scoring.SLOTS, CLASSES) and of_branch.any()
    assert lm_scoring.slots_for(1 << 20) * CLASSES == 1 << 21 > lm_scoring.slots_for(1 << 19) * CLASSES


def test_a_slot_keeps_what_the_only_task_that_saw_it_learnt():
    start, size = np.zeros(lm_scoring.BLOCK, np.float32), lm_scoring.BLOCK
    parts = []
    for change, seen in ((0.5, 3.0), (0.25, 1.0)):
        weights, square = np.zeros(size, np.float32), np.ones(size, np.float32)
        weights[7], square[7] = change, 1 + seen
        if seen > 1:
            weights[9], square[9] = -0.5, 1.25
        parts += lm_scoring.changes(start, weights, square, 2)
    (mean,) = lm_scoring.mean_changes(iter(parts))
    got = np.frombuffer(mean.column(1)[0].as_py(), np.float32)
    assert mean.column(0).to_pylist() == [2] and got[7] == 0.4375 and got[9] == -0.5 and np.count_nonzero(got) == 2


def test_words_of_any_bytes():
    texts = [b" A b\tc\x0bd\x0c\x1ce  f\n", b"", b"  ", "\u00c4x\u00a0Y \u0085 z".encode(), b"\xff X"]
    sizes, found = lm_scoring.words(lm_scoring.pa.array(texts, lm_scoring.pa.binary()))
    want = [t.lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and found.to_pylist() == [w for t in want for w in t]
    assert lm_scoring.names_of(found) == found.dictionary.to_pylist()


def test_arrays_out_of_a_pickle_get_numpys_own_dtype():
    """Broadcast arrays come out of a pickle; with the dtype object they bring, a scatter took some tens of times as long."""
    tree = pickle.loads(pickle.dumps(small_tree()[2]))
    for x in (tree.first, tree.above, tree.odds, tree.room, lm_scoring.plain(pickle.loads(pickle.dumps(np.zeros(3, np.float32))))):
        assert x.dtype is np.dtype(x.dtype.type)


def test_checksums_are_those_of_zlib():
    draw = np.random.default_rng(4)
    tokens = [draw.bytes(n) for n in [0, 1, 2, 3, 47, 48, 49, 50, 5000, *draw.integers(0, 60, 300).tolist()]]
    for some in (tokens, tokens[:1], []):
        column = lm_scoring.pa.array([b"left out", *some], lm_scoring.pa.binary())[1:]
        assert lm_scoring.crc32s(column).tolist() == [zlib.crc32(t) for t in some]
        assert lm_scoring.crc32s(column, 3).tolist() == [zlib.crc32(t[-3:]) for t in some]


def test_a_reader_gives_every_token_its_entry():
    words, vocabulary, tree = small_tree()
    texts = [b" ".join(words[i::3]) + b" Unseen one" for i in range(3)] + [b"", b"  "]
    reader = Reader(vocabulary, tree)
    ids, starts = reader.read(texts)
    for text, start in zip(texts, starts, strict=True):
        assert not ids[start - lm_scoring.BEFORE : start].any()
        for i, token in enumerate([*text.lower().split(), b""]):
            at, hashed = ids[start + i], zlib.crc32(token)
            assert reader.names[at - 1].as_py() == token and reader.hash[at] == hashed and (reader.kind[at], reader.count[at]) == vocabulary.of(token)
            shared = tree.shared[ending_class(token) - lm_scoring.OWN - lm_scoring.SHARED] + (hashed >> 32 - tree.bits)
            assert reader.leaf[at] == tree.place.get(token, shared)


def test_totals_of_short_and_long_runs():
    draw = np.random.default_rng(6)
    size = np.array([1, 40, 2, 8, 9, 1, 100, 3])
    rows, order = draw.normal(size=(50, 4)).astype(np.float32), draw.integers(0, 50, size.sum())
    want = np.stack([rows[part].sum(0) for part in np.split(order, np.cumsum(size)[:-1])])
    assert np.allclose(lm_scoring.totals(rows, order, np.cumsum(size) - size), want, atol=1e-4)


def test_classes_with_scores_beyond_what_an_exponential_holds():
    slots, bias = np.zeros((4, 2), np.int64), np.zeros(CLASSES, np.float32)
    for far in (60, -60):
        weights = np.full((1, CLASSES), far, np.float32)
        weights[0, 3] += 1
        p = np.exp(log_classes(weights, bias, slots))
        assert np.allclose(p.sum(1), 1) and np.allclose(p[:, 3] / p[:, 0], np.exp(4), rtol=1e-4)


def test_counts_drained_in_parts(docs):
    want = Counter(w for r in docs.collect() for w in [*(r.text or "").encode().lower().split(), b""])
    for room in (3, 200_000):
        assert {bytes(r.token): r.c for r in lm_scoring.count_tokens(docs, room=room).collect()} == want


def test_rare_tokens_meet_their_counts_without_sorting(docs, monkeypatch):
    """The same rows either way; partitions with more tokens than a hash table should hold are sorted."""
    got = []
    for most in (lm_scoring.HASHED, 0):
        monkeypatch.setattr(lm_scoring, "HASHED", most)
        out = lm_scores(docs, docs.where("doc_id <> 8"), rounds=1, head=5)
        assert ("ShuffledHashJoin" in out._jdf.queryExecution().sparkPlan().toString()) == (most > 0)
        got.append(sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out.collect()))
    assert got[0] == got[1]
