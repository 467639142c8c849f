"""Small DataFrame helpers shared by the operators; written tables and checked broadcasts come from ``graphset.storage``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.storage import join_hot, numbered, save, scratch_dir, small

__all__ = ["free_name", "join_hot", "numbered", "save", "scratch_dir", "small", "small_batches", "table"]

#: Rows of whole texts that go to a Python worker at once, at most.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it a name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what the session sends to a Python worker at once, so that buffers on either side stay at some megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
