"""Queries of the classifiers: quality and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.quality import fit_quality, score_quality
from graphset.llm.toxicity import toxicity


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier, "op10_toxicity": op10_toxicity}
#: Trained models cannot be written in SQL; they are tested by held-out accuracy.
SQL: dict[str, str] = {}
