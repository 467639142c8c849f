"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_tables", "q_mining", "q_vectors", "q_scores", "q_assembly"]


#: Written graph tables are columns of small numbers, which take up to so many times their file's size in memory; Spark is told,
#: so that it sends none to all executors, through the driver, for the size of its file.
FILE_FACTOR = "64"


def _sized(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)
        # graphs that lie together by gid are joined by gid and more without being shuffled again
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sized(q) for m in MODULES for k, q in importlib.import_module(f"graphset.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in importlib.import_module(f"graphset.plans.{m}").SQL.items()}
