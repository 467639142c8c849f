"""Written tables in the folder that all executors share, checked broadcast, and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (as Parquet) and rows of a table that is sent to every executor at most.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000
#: A key with more than this share of the rows is hot; there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 256
#: Tasks over which the rows of a hot key are dealt.
SALTS = 128


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; where it is unset on a local master (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("graphset.scratch.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-graphset-")
            spark.conf.set("graphset.scratch.dir", base)
    return f"{base.rstrip('/')}/graphset"


def save(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (as ``schema``, if given, which must be laid out alike):
    loops stay short in lineage and survive lost executors.

    The shuffle files of the finished job are dropped at once, for the written table replaces them.  Spark itself sends a
    written table to all executors in a join where its size allows.
    """
    spark = df.sparkSession
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(schema or df.schema).parquet(path)


def is_small(done: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many bytes and rows."""
    files = done.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"), F.count("*").alias("n"))
    size, rows = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return size <= max_bytes and rows <= max_rows


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written, with a broadcast hint if it has at most so many bytes and rows, else without."""
    done = save(df)
    return F.broadcast(done) if is_small(done, max_bytes, max_rows) else done


def join_hot(rows: DataFrame, values: DataFrame, keys: list[str], n: str, share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``values`` (a written table), which has one row for each key and says in ``n`` how many rows have it.

    The rows of a hot key are dealt over ``salts`` tasks, each of which gets the key's value, so no task gets all of them.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total * share
    few = F.broadcast(values.filter(hot).select(*keys, F.lit(True).alias("is_hot")))
    salt = F.when(F.col("is_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)
    left = rows.join(few, keys, "left").withColumn("salt", salt).drop("is_hot")
    right = values.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with its rows numbered from 0 in that order, by ranges and without bringing all rows to one task.

    Equal rows of the order are numbered in any order.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = save(df.repartitionByRange(parts, *order).withColumn("part_of_range", F.spark_partition_id()))
    # one row for each of ``parts`` ranges
    sizes = dealt.groupBy("part_of_range").agg(F.count("*").alias("rows_of_range"))
    before = F.coalesce(F.sum("rows_of_range").over(Window.orderBy("part_of_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part_of_range", before.alias("rows_before"))
    own = F.row_number().over(Window.partitionBy("part_of_range").orderBy(*order)) - 1
    out = dealt.withColumn(name, own).join(F.broadcast(sizes), "part_of_range")
    return out.withColumn(name, F.col(name) + F.col("rows_before")).drop("part_of_range", "rows_before")
