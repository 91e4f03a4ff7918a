import pytest
from brute import components, cut_repeats, words
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panelspark.llm import mixing, queries, toxicity
from panelspark.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "packing"]
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in toxicity.score(stages[0], model).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_one_document_of_each_group_stays(stages):
    reached = components([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(reached.values()))


def test_repeats_are_cut(stages):
    want = {i: kept for i, _, _, kept in cut_repeats([(r.doc_id, r.text) for r in stages[2].collect()], 13)}
    assert {r.doc_id: " ".join(words(r.text)) for r in stages[3].collect()} == want


def test_mix_and_bins_agree(stages):
    taken = mixing.mix(stages[3]).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r.text)) for r in stages[4].collect()) == taken
    packed = stages[5].collect()
    assert sum(r.size for r in packed) == taken
    assert max(r.bin_size for r in packed) <= 2048


@pytest.mark.parametrize("at", range(5))
def test_stages_on_edge_rows_and_on_nothing(spark, edge, nothing, at):
    name, stage = pipeline.STAGES[at]
    scratch = Scratch(spark, "test-edge")
    for n, docs in enumerate((edge, nothing)):
        out = scratch.write(stage(spark, docs, SF), f"{name}-{n}")
        assert at == 4 or out.columns == edge.columns
        assert out.count() == 0 if docs is nothing else out.count() > 0


def test_registered(spark):
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
