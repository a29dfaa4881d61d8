"""The pipeline: its stages in order, their columns, and that each works on what the one before kept."""

import pytest

import corpus_pipeline
from saltmarsh.llm import registry
from tests.oracle import assert_same, views


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_text_query_equals_sql(spark, data, name):
    assert_same(registry.QUERIES[name](spark, data), views(data), registry.ORACLES[name])


def test_stages_pass_documents_on_and_run_equals_them(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2] and counts[5] > 0
    # Which sequence a piece goes to depends on how the rows are dealt to tasks; what is packed does not.
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert pieces(corpus_pipeline.run(spark, data)) == pieces(docs)


def test_stages_on_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
