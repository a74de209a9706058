"""The corpus pipeline and its registration."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from keyhound.llm import decontaminate, ngram_join, pii
from keyhound.llm import queries as llm


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = llm.table(spark, tables, "documents")
    out = {"documents": docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{folder}/{k}")
        docs = out[name] = spark.read.parquet(f"{folder}/{k}")
    return out


def test_all_queries_are_registered():
    names = entry.queries()
    assert {"op%d_" % n for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_keep_the_columns_of_documents(steps):
    for name in [x for x, _ in corpus_pipeline.STAGES][:-1]:
        assert steps[name].columns == steps["documents"].columns


def test_each_stage_takes_effect(spark, tables, steps):
    kept = {r["doc_id"] for r in steps["quality"].collect()}
    labels = llm.table(spark, tables, "labels").where("quality IS NOT NULL").collect()
    wrong = [r for r in labels if (r["doc_id"] in kept) != (r["quality"] == 1)]
    assert len(wrong) <= 0.08 * len(labels)

    after = ngram_join.join(steps["near copies"])
    assert after.where("class_id <> doc_id OR n_links > 0").count() == 0
    assert {r["doc_id"] for r in steps["near copies"].collect()} <= kept

    bench = llm.table(spark, tables, "benchmark")
    assert decontaminate.contamination(steps["decontamination"], bench).where("size(hits) > 0").count() == 0

    model = pii.train(steps["personal data"])
    assert pii.find(steps["personal data"], model, ["doc_id"]).where("size(spans) > 0").count() == 0
    assert steps["personal data"].count() == steps["decontamination"].count()
    packed = {r["doc_id"] for r in steps["packing"].select("doc_id").distinct().collect()}
    assert packed == {r["doc_id"] for r in steps["personal data"].collect()}


def test_run_equals_the_stages(spark, tables, steps):
    assert corpus_pipeline.run(spark, tables).count() == steps["packing"].count()
