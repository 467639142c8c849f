"""Query of the quartile bucket digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.quartile_digest import compare_with_edits


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op11_document_fingerprints": op11_document_fingerprints}
#: SQL cannot count hashed triplets of bytes; texts, digests and scores are tested against brute force.
SQL: dict[str, str] = {}
