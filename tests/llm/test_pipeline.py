from collections import defaultdict

import pytest

from tests.llm.conftest import SCHEMA, awkward, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = awkward() + [(100 + i, words(i, 60, 5000), "en", "abc"[i % 3]) + (None, 7, "k", 1, 0.5, False, "r") for i in range(60)]
    rows += [(200 + i, words(7, 80, 5000) + f" tail{i}", "en", "b") + (None, 7, "k", 1, 0.5, False, "r") for i in range(6)]
    rows += [(300 + i, words(300 + i, 60).upper().replace(" ", "!! "), "en", "a") + (None, 7, "k", 1, 0.5, False, "r") for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(300 + i, 0) for i in range(30)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_keeps_its_promise(spark, folder):
    from driftloom.llm.exact_dedup import exact_groups
    from driftloom.llm.mixing import mixed
    from driftloom.llm.simhash import near_components

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "packing"]
    from driftloom.llm.common import written
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], folder)))
    assert all(s.columns == docs.columns for s in states[:-1])
    good, exact, near, mix, packed = states[1:]
    kept = {r.doc_id for r in good.collect()}
    assert kept >= set(range(100, 160)) and not kept & set(range(300, 330))
    assert exact.count() == exact_groups(good).where("kept").count() and exact_groups(exact).agg({"group_size": "max"}).first()[0] == 1
    sizes = near_components(near).groupBy("root").count()
    assert sizes.agg({"count": "max"}).first()[0] == 1 and near.count() == near_components(exact).select("root").distinct().count()
    copies = {r.doc_id: r.copies for r in mixed(near).collect() if r.copies}
    got = defaultdict(int)
    for r in mix.collect():
        got[r.doc_id] += 1
    assert got == copies
    starts = defaultdict(int)
    for r in packed.where("start = 0").collect():
        starts[r.doc_id] += 1
    assert starts == copies


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
