"""Graph sets made from the relational tables: orders as graphs of their lines, users as graphs of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphset.storage import save

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_vertices(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """gid, vid, vlb, n (lines of the order) and more columns of lineitem; one shuffle, by order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *{*LINE_ORDER, *more})
    w = Window.partitionBy("l_orderkey")
    return line.select(
        F.col("l_orderkey").alias("gid"),
        (F.row_number().over(w.orderBy(*LINE_ORDER)) - 1).alias("vid"),
        F.concat("l_returnflag", "l_linestatus").alias("vlb"),
        F.count("*").over(w).cast("int").alias("n"),
        *more,
    )


def order_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_vertices(spark, sf_dir).select("gid", "vid", "vlb")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(sized_vertices(spark, sf_dir))


def edges_of(sized: DataFrame) -> DataFrame:
    """Lines in a row (label 1), first and last line (2), and chords from every fourth line (1); eid is 4 src + kind."""
    v, n = F.col("vid"), F.col("n")
    kinds = [(v + 1 < n, v, v + 1, "1"), ((v == 0) & (n >= 3), F.lit(0), n - 1, "2"), ((v % 4 == 0) & (v + 3 < n - 1), v, v + 3, "1")]
    rows = F.array(*(F.when(on, F.struct((a * 4 + k).alias("eid"), a.alias("src"), b.alias("dst"), F.lit(lab).alias("elb"))) for k, (on, a, b, lab) in enumerate(kinds)))
    return sized.select("gid", F.explode(F.array_compact(rows)).alias("x")).select("gid", "x.eid", "x.src", "x.dst", "x.elb")


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return order_vertices(spark, sf_dir), order_edges(spark, sf_dir)


def written_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``order_graphs`` from one written table: lines are shuffled and sorted once for both."""
    sized = save(sized_vertices(spark, sf_dir))
    return sized.select("gid", "vid", "vlb"), edges_of(sized)


def event_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid (user), pos, src, dst (event types of an event and the next), elb (hour): parallel arcs are frequent."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("gid"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.hour("ts").cast("string").alias("elb"))
    return e.filter("dst IS NOT NULL")


#: The same graphs in DuckDB's SQL: gv (vertices), gn (sizes), ge0 (edges, once a pair), ge (both directions).
SQL = """
gv AS (SELECT l_orderkey AS gid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_extendedprice, l_quantity, l_shipdate) - 1 AS INT) AS vid, concat(l_returnflag, l_linestatus) AS vlb FROM lineitem),
gn AS (SELECT gid, CAST(max(vid) + 1 AS INT) AS n FROM gv GROUP BY gid),
ge0 AS (
  SELECT gid, vid * 4 AS eid, vid AS src, vid + 1 AS dst, '1' AS elb FROM gv JOIN gn USING (gid) WHERE vid + 1 < n
  UNION ALL SELECT gid, 1, 0, n - 1, '2' FROM gn WHERE n >= 3
  UNION ALL SELECT gid, vid * 4 + 2, vid, vid + 3, '1' FROM gv JOIN gn USING (gid) WHERE vid % 4 = 0 AND vid + 3 < n - 1),
ge AS (SELECT gid, eid, src, dst, elb FROM ge0 UNION ALL SELECT gid, eid, dst, src, elb FROM ge0)"""
