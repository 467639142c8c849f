"""Bridges of large graphs, in rounds that grow with the logarithm of their size.

A spanning forest is contracted from the edges.  Every other edge gets a random number; around a tree edge, the numbers of the
other edges that join its two sides are combined by exclusive or, and nothing else leaves a zero but a bridge (or, once in
2**64, chance).  These sums over the two sides come from one tour around each tree, whose sums are doubled in length each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphset.storage import save

#: Pointers are followed so many times before a look at whether that was enough.
JUMPS = 3


def spanning_forest(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, eid) of the edges of a spanning forest, and (gid, vid, comp) of all vertices of ``e``."""
    vertices = e.select("gid", F.explode(F.array("src", "dst")).alias("vid")).distinct()
    label = save(vertices.withColumn("comp", F.col("vid")))
    left = save(e.select("gid", "eid", F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b"))
    chosen = None
    while not left.isEmpty():
        # the order of edges is the same all round, so picks close no cycle but that of two that pick the same edge
        order = F.struct(F.xxhash64("gid", "eid").alias("h"), "eid")
        sides = left.select("gid", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s"), order.alias("o"))
        pick = save(sides.groupBy("gid", F.col("s.x").alias("x")).agg(F.min(F.struct("o", F.col("s.y").alias("y"))).alias("p")).select("gid", "x", F.col("p.y").alias("to"), F.col("p.o.eid").alias("eid")))
        edges = pick.select("gid", "eid").distinct()
        chosen = edges if chosen is None else chosen.unionByName(edges)
        other = pick.select("gid", F.col("x").alias("to"), F.col("to").alias("back"))
        up = pick.join(other, ["gid", "to"]).select("gid", "x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to"))
        while True:
            for _ in range(JUMPS):
                far = up.select("gid", F.col("x").alias("to"), F.col("to").alias("far"))
                up = up.join(far, ["gid", "to"]).select("gid", "x", F.col("far").alias("to"))
            up = save(up)
            if up.join(up.select("gid", F.col("x").alias("to"), F.col("to").alias("far")), ["gid", "to"]).filter("to <> far").isEmpty():
                break

        def follow(df: DataFrame, c: str, up: DataFrame = up) -> DataFrame:
            return df.join(up.select("gid", F.col("x").alias(c), F.col("to").alias("at")), ["gid", c], "left").withColumn(c, F.coalesce("at", c)).drop("at")

        label = save(follow(label, "comp").select("gid", "vid", "comp"))
        left = save(follow(follow(left, "a"), "b").filter("a <> b").select("gid", "eid", "a", "b"))
    return (e.select("gid", "eid").limit(0) if chosen is None else save(chosen.distinct())), label


def ring_ids(e: DataFrame) -> DataFrame:
    """(gid, eid) of the edges that are no bridges; loops are left out."""
    e = save(e.select("gid", "eid", "src", "dst").filter("src <> dst"))
    tree, label = spanning_forest(e)
    rest = save(e.join(tree, ["gid", "eid"], "left_anti"))
    own = rest.select("gid", F.explode(F.array("src", "dst")).alias("v"), F.xxhash64("gid", "eid").alias("r")).groupBy("gid", "v").agg(F.expr("bit_xor(r)").alias("r"))
    ends = [F.struct(F.lit(k).alias("way"), F.col(a).alias("u"), F.col(b).alias("v")) for k, a, b in ((0, "src", "dst"), (1, "dst", "src"))]
    arcs = e.join(tree, ["gid", "eid"], "left_semi").select("gid", "eid", F.explode(F.array(*ends)).alias("x")).select("gid", "eid", "x.*")
    around = Window.partitionBy("gid", "u").orderBy("v", "eid")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arc = F.struct("eid", "way")
    # behind the arc that comes back along this one, the tour goes on along the next arc around this one's tail
    turn = arcs.select("gid", "eid", (1 - F.col("way")).alias("way"), F.coalesce(F.lead(arc).over(around), F.first(arc).over(whole)).alias("next"), (F.row_number().over(around) == 1).alias("counts"), F.col("u").alias("v"))
    start = arcs.join(label, (arcs["gid"] == label["gid"]) & (arcs["u"] == label["vid"])).groupBy(arcs["gid"].alias("gid"), "comp").agg(F.min(arc).alias("next")).select("gid", "next", F.lit(True).alias("starts"))
    tour = turn.join(start, ["gid", "next"], "left").join(own, ["gid", "v"], "left")
    value = F.when(F.col("counts"), F.coalesce("r", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    tour = save(tour.select("gid", arc.alias("arc"), F.when(F.col("starts").isNull(), F.col("next")).alias("next"), value.alias("sum")))
    while True:
        ahead = tour.select("gid", F.col("arc").alias("next"), F.col("next").alias("far"), F.col("sum").alias("more"))
        tour = save(tour.join(ahead, ["gid", "next"], "left").select("gid", "arc", F.col("far").alias("next"), F.col("sum").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long"))).alias("sum")))
        if tour.filter("next IS NOT NULL").isEmpty():
            break
    crossed = tour.groupBy("gid", F.col("arc.eid").alias("eid")).agg(F.expr("bit_xor(sum)").alias("sum")).filter("sum <> 0")
    return save(crossed.select("gid", "eid").unionByName(rest.select("gid", "eid")))
