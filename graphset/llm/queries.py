"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold QUERIES and SQL, by operator number.
MODULES = ["q_scans", "q_joins", "q_text", "q_models", "q_mix", "q_digests", "q_collocations", "q_manifest"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"graphset.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"graphset.llm.{name}").SQL
    return out
