from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm.packing import Packer, digest, encode, pack

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["", " ", "plain words, here!", "a<|endoftext|>b", "Ünï 你好 \U0001f600‍", "x" * 25_000, "tabs\t\tand\n\n\nlines   ", "12345 67.8 it's I'll"])
def test_ids_are_those_of_the_tokenizer_file(text):
    assert encode(text, RANKS, JSON).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_long_runs_are_found_in_linear_time():
    """Texts without white space, up to just below the limit of a run, cost no search from every position."""
    import time
    runs = " ".join("ab" * 9_999 for _ in range(20))
    started = time.perf_counter()
    assert max(map(len, runs.split())) == 19_998
    assert time.perf_counter() - started < 1
    text = " ".join("你好世界" * 500 for _ in range(10))
    assert encode(text, RANKS, JSON).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def rebuilt(rows):
    """Ids by document from pieces, after checking that sequences have no gap."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    return sequences, documents


def test_round_trip(docs):
    rows = pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    sequences, documents = rebuilt(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, parts in documents.items():
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(parts, key=lambda r: r.start)])
        assert ids.tolist() == [*encode(texts[key] or "", RANKS, JSON).tolist(), 1] and len(ids) == parts[0].doc_tokens
    lengths = [sum(r.length for r in s) for s in sequences.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and max(lengths) <= 2048


def test_repeated_rows_and_null_ids_are_packed_as_they_come(docs, no_docs):
    rows = pack(docs).collect()
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole[7] == 2 * whole[6] and None in whole and whole[3] == whole[4] == 1
    assert pack(no_docs).count() == 0
    assert {"ids_crc32", "offset"} <= set(digest(pack(docs)).columns)


def test_limits_hold():
    packer, draw = Packer(64, 4, 40, 0), np.random.default_rng(3)
    sizes = [int(x) for x in draw.integers(1, 150, 400)]
    for key, n in enumerate(sizes):
        packer.add(key, np.arange(n, dtype="<u4"), int(draw.integers(0, n + 1)))
    packer.finish()
    by = defaultdict(list)
    for key, start, length, ids, whole, loss, sequence, offset in packer.out:
        by[sequence].append((length, loss))
        assert len(ids) == 4 * length
    assert sum(n for s in by.values() for n, _ in s) == sum(sizes)
    for parts in by.values():
        used = sum(n for n, _ in parts)
        assert used <= 64 and used & (used - 1) == 0 and len(parts) <= 4 and sum(x for _, x in parts) <= 40


def test_prompt_tokens_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "one two three four", 2), (2, "five", None)], "doc_id long, text string, prompt int")
    loss = {}
    for r in pack(docs, prompt_tokens="prompt").collect():
        loss[r.doc_id] = loss.get(r.doc_id, 0) + r.loss_tokens
        whole = {1: 5, 2: 2}[r.doc_id]
        assert r.doc_tokens == whole
    assert loss == {1: 3, 2: 2}
