"""The pipeline's stages on the smallest tables: what each keeps, drops and changes."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from graphset.llm.common import save, table
from graphset.llm.decontaminate import tile_benchmark
from graphset.llm.jaccard_join import jaccard_classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages_in_a_row(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = save(stage(spark, docs, DATA))
        assert out.columns == columns, name
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.5 * len(before), name
        if name == "ngram_jaccard_join":
            groups = {}
            for r in jaccard_classes(docs).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert after == {min(g) for g in groups.values()}
        if name == "benchmark_decontamination":
            assert before - after == {r.doc_id for r in tile_benchmark(docs, table(spark, DATA, "benchmark")).collect()}
        if name == "secret_scan":
            assert after == before
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert set(columns) < set(mixed.columns)
    total = sum(r.size for r in mixed.select("size").collect())
    assert mixed.filter("copies < 1 OR copies > 2 OR taken <> copies * size").isEmpty() and total > 0
