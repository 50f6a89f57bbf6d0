import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.llm.common import Rows
from driftloom.llm.exact_dedup import drop_copies, exact_groups, normalised
from driftloom.llm.simhash import drop_near


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[plain(text)].append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_groups_agree_with_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    for limit in (1000, 3):  # one list, and passes over parts of it
        got = exact_groups(docs, carry={"plain": normalised(F.col("_text"))}, listed_rows=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.keep_id, r.group_size) == expected[r.plain]
        kept = [r for r in got if r.kept]
        assert len(kept) == len(expected) and {r.plain for r in kept} == set(expected)
        assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_copies_keeps_one_row_of_each_text(docs):
    got = drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(plain(r.text) for r in rows) == sorted({plain(r.text) for r in docs.collect()})
    assert {r.doc_id for r in rows} == {1, 3, 5, 6, None, 8, 9, 10} and all(r._row == "r" and r.size == 7 for r in rows)


def test_ids_used_by_several_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in drop_copies(docs).collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_same_length_and_prefix_are_not_equal(spark):
    start = "p" * 300
    docs = spark.createDataFrame([(1, start + "a"), (2, start + "b"), (3, start + "a")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()} == {(1, 1, 2), (2, 2, 1), (3, 1, 2)}


def exchanged(frame):
    """What lies below the exchanges of a plan."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    return [x for i, line in enumerate(lines) if "Exchange hash" in line or "Exchange range" in line or "Exchange Round" in line
            for x, d in zip(lines[i + 1 :], depth[i + 1 :], strict=True) if d > depth[i]]


@pytest.mark.parametrize("listed", [1_000_000, 40])
def test_no_exchange_below_texts_and_one_plan_at_every_size(spark, tmp_path, listed):
    """Passes over parts of the list leave the same rows as one list, and no plan moves a text."""
    rows = [(i, f"text number {i % 700}", "x", 1) for i in range(2000)]
    path = f"{tmp_path}/docs.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, _row string, _at int").repartition(5).write.parquet(path)
    got = drop_copies(spark.read.parquet(path), listed_rows=listed)
    assert not exchanged(got)
    assert sorted(r.doc_id for r in got.collect()) == list(range(700)) and got.columns == ["doc_id", "text", "_row", "_at"]
    near = drop_near(spark.read.parquet(path), listed_rows=listed)
    assert not exchanged(near) and {r.text for r in near.collect()} <= {r[1] for r in rows}


def test_rows_of_a_joined_frame_are_written_first(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    twice = docs.crossJoin(spark.range(3)).drop("id")
    assert Rows(docs).docs is docs and Rows(twice).docs is not twice
    assert sorted(r.doc_id for r in drop_copies(twice).collect()) == [1, 2]
    assert [r.doc_id for r in drop_copies(docs.where("doc_id = 2").select("doc_id", "text")).collect()] == [2]


def test_empty(no_docs):
    assert exact_groups(no_docs).count() == 0 and drop_copies(no_docs).count() == 0
