"""Summaries, samples and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphset.storage import numbered


def count_ids(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """id, n over comma-joined ids."""
    return df.select(F.explode(F.split(column, sep)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, score: str, tie: str, k: int = 100) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def top_k_mean(df: DataFrame, score: str, tie: str, k: int = 100) -> DataFrame:
    return top_k(df, score, tie, k).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def best_by(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of the highest score of each key, the first by ``tie``; combined before the shuffle."""
    best = F.max_by(F.struct(*df.columns), F.struct(score, (-F.col(tie)).alias("t")))
    return df.groupBy(F.col(key).alias("best_key")).agg(best.alias("b")).select("b.*")


def sample_rows(df: DataFrame, n: int, seed: int, order: str) -> DataFrame:
    """n rows drawn with replacement: draw i takes the row that ranks hash(seed, i) modulo the count."""
    count = df.count()
    if count == 0 or n == 0:
        return df.limit(0)
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).alias("rank"))
    ranked = numbered(df, order, name="rank")
    return draws.join(ranked, "rank").select("draw", *df.columns)


def class_ranges(df: DataFrame, label: str, value: str, pad: float = 0.1) -> DataFrame:
    """label, low, high: padded ranges of the classes that have more than one row."""
    r = df.groupBy(label).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("n")).filter("n > 1")
    width = (F.col("b") - F.col("a")) * pad
    return r.select(label, (F.col("a") - width).alias("low"), (F.col("b") + width).alias("high"), "n")


def kde(df: DataFrame, label: str, value: str, grid: list[float]) -> DataFrame:
    """label, x, density: Gaussian densities of each class on a grid, with Scott's width."""
    s = df.groupBy(label).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).filter("n > 1 AND sd > 0").withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    points = df.join(s, label).withColumn("x", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    u = (F.col("x") - F.col(value)) / F.col("h")
    k = F.exp(-0.5 * u * u) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
    return points.groupBy(label, "x").agg(F.sum(k).alias("density"))
