"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphset.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """node, root: for each end of the links (x, y), a node that all nodes reachable from it have in common.

    In each round every node takes the neighbour (or itself) that a fresh pseudo-random order puts first; nodes then merge
    into what they took, which halves the rest on average even in long chains.  A node's root is whichever remains.
    """
    edges = save(links.select("x", "y").filter("x <> y").distinct())
    roots: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():

        def order(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))

        both = edges.union(edges.select("y", "x"))
        took = both.groupBy("x").agg(F.min(order("y")).alias("best")).select(F.col("x").alias("node"), F.when(F.col("best") < order("x"), F.col("best.v")).otherwise(F.col("x")).alias("root"))
        took = save(took)
        if roots is None:
            roots = took
        else:
            nxt = took.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = save(roots.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a = took.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        b = took.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = save(edges.join(a, "x").join(b, "y").filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
        turn += 1
    return links.select(F.col("x").alias("node"), F.col("x").alias("root")).limit(0) if roots is None else roots
