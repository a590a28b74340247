"""The pipeline on the smallest tables: each stage does what its operator says, to all rows that are left."""

import os

import pytest

import corpus_pipeline
from furrow.llm.common import load

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = load(spark, SF, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left, name
        left = docs.count()
        assert docs.select("doc_id").distinct().count() == left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert os.path.exists(SF) or pytest.skip("no tables here")
