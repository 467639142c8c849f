"""Queries of the license and secret scans and of decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.decontaminate import tile_benchmark
from graphset.llm.license_scan import scan_licenses
from graphset.llm.secret_findings import labelled_findings
from graphset.llm.secret_scan import fit_forest, scan_secrets


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_forest(labelled_findings(spark)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


QUERIES = {"op1_license_scan": op1_license_scan, "op2_secret_scan": op2_secret_scan, "op4_decontamination": op4_decontamination}
#: Neither diagonal votes, trained forests nor greedy tiling can be written in SQL.  The tests set places of phrases and tiles
#: against brute force, notices against planted ones, and the forest against held-out findings.
SQL: dict[str, str] = {}
