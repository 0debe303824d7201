"""The pipeline's stages take effect one after another."""

import os

import pytest

pytest.importorskip("quern.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, DATA))
        sizes.append(kept.count())
        if name != "byte_bpe":
            assert kept.columns == docs.columns
        if name == "secret_scan":
            from quern.llm.secret_scan import spans

            assert spans(kept).where("kind in ('assign', 'access', 'hex')").count() == 0
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < docs.count()
    out = corpus_pipeline.run(spark, DATA)
    assert {(r.doc_id, r.ids_sha256) for r in out.collect()} == {(r.doc_id, r.ids_sha256) for r in kept.collect()}


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
