"""Queries of extraction and of substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.html_extract import extract_text
from graphset.llm.substring_dedup import repeated_units


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op6_html_extraction": op6_html_extraction, "op9_substring_dedup": op9_substring_dedup}
#: Neither parsing nor offsets of normalised units can be written in SQL: extraction is tested on pages of other layouts than
#: those it was trained on, repeated units against brute force.
SQL: dict[str, str] = {}
