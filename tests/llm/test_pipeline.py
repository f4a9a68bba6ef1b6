import importlib
import os
from types import SimpleNamespace

import pytest
from test_jaccard import brute_kept

import corpus_pipeline
from millrace.llm import common, mixing, pii, quality


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    documents = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i == 3 else 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_act_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.count() > 0
        if name != "packing":
            assert docs.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality":
            kept = {r.doc_id for r in quality.score_quality(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "near_dedup":
            keep = brute_kept([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} - {None} == keep and len(keep) < len(ids)
        if name == "pii":
            assert docs.count() == before.count() and not any(pii.base_spans(r.text or "") for r in docs.collect())
        if name == "mixing":
            assert docs.count() == sum(r.copies for r in mixing.mix(before).collect())
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == ids


def test_run_leaves_only_what_the_result_reads(spark, sf_dir):
    made = []

    def noted(df, label, materialize=common.materialize):
        made.append(materialize(df, label))
        return made[-1]

    with pytest.MonkeyPatch.context() as patch:
        for module in (corpus_pipeline, *(importlib.import_module(f"millrace.llm.{m}") for m in ("components", "jaccard", "mixing", "packing", "pii", "simhash"))):
            if hasattr(module, "materialize"):
                patch.setattr(module, "materialize", noted)
        assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = {os.path.basename(d._millrace_path).rsplit("-", 1)[0] for d in made if os.path.exists(d._millrace_path.removeprefix("file:"))}
    assert left == {"stage-mixing", "pieces"}


def test_materialized_tables(spark, tmp_path, monkeypatch):
    df = common.materialize(spark.range(3), "three")
    assert df.count() == 3
    common.discard(df)
    assert not os.path.exists(df._millrace_path)
    with common.discarding() as made:
        inner = common.materialize(spark.range(2), "two")
        kept = common.materialize(inner, "kept")
        made.pop()
    assert kept.count() == 2 and not os.path.exists(inner._millrace_path)
    common.clean_up(spark)
    assert not os.path.exists(kept._millrace_path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    def session(master, folder=None, conf=None):
        context = SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(session("local-cluster[2,1,1024]"))
    assert common.shared_folder(session("yarn", "hdfs://x/cp/")) == "hdfs://x/cp"
    assert common.shared_folder(session("yarn", "hdfs://x/cp", "s3://y")) == "s3://y"
    assert common.shared_folder(session("local[4]"))
