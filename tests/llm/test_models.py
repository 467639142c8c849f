"""Held-out accuracy of the trained operators on the labelled tables."""

from __future__ import annotations

import os

import pytest

from graphset.llm import toxicity as tox
from graphset.llm.common import table
from graphset.llm.quality import fit_quality, score_quality

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    held = tox.toxicity(docs, labels).filter("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * n[0, 0]


def test_toxicity_cases(spark):
    rows = [(1, "fine words here"), (1, "fine words here"), (None, "you vile thing"), (2, None), (3, ""), (4, "vile " + "word " * 200_000), (5, "vile you")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(5, 1), (1, 0), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = tox.score_toxicity(docs, tox.fit(docs, labels, least_g=0.0)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert tox.score_toxicity(docs.limit(0), tox.fit(docs.limit(0), labels)).count() == 0
    kept = tox.keep_civil(docs, tox.fit(docs, labels, least_g=0.0))
    assert kept.columns == docs.columns


def test_quality_against_labels_it_has_not_seen(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = score_quality(docs, fit_quality(docs)).join(labels, "doc_id").select("score", "keep", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above >= 0.97
    assert sum(r.keep for r in rows if r.quality == 1) >= 0.95 * len(good) and sum(not r.keep for r in rows if r.quality == 0) >= 0.85 * len(bad)


def test_quality_cases(spark):
    rows = [(None, "A fine line of words. And one more of them."), (1, "x | y | z | w | v"), (1, "x | y | z | w | v"), (2, None), (3, ""), (4, "word and word. " * 100_000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, p int")
    got = score_quality(docs, fit_quality(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0))).count() == 0
