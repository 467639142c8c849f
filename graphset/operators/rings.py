"""Components, rings, cliques and junction trees inside each graph.

Rings are all shortest cycles through each edge, however long: deterministic and relational.  In cage-like graphs there may be
more of them than in a smallest cycle basis, which ``cycle_basis`` gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphset.operators.alike import alike
from graphset.operators.bridges import ring_ids
from graphset.operators.codes import shapes, with_codes
from graphset.operators.cycles import in_each_graph, on_cycles, packed_edges, shortest_cycles, smallest_basis
from graphset.operators.tables import degrees, symmetrize
from graphset.storage import save

#: Edges of a graph that is searched within one task.
LOCAL_EDGES = 1_000


def components(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, vid, comp: the smallest vertex that is reachable.  Each round passes labels on and then jumps along them."""
    arcs = symmetrize(e.select("gid", "src", "dst"))
    label = save(v.select("gid", "vid", F.col("vid").alias("comp")))
    while True:
        near = arcs.join(label.withColumnRenamed("vid", "dst"), ["gid", "dst"]).groupBy("gid", F.col("src").alias("vid")).agg(F.min("comp").alias("least"))
        new = label.join(near, ["gid", "vid"], "left").select("gid", "vid", F.least("comp", "least").alias("new"), F.col("comp").alias("old"))
        jump = new.select("gid", F.col("vid").alias("new"), F.col("new").alias("far"))
        new = save(new.join(jump, ["gid", "new"]).select("gid", "vid", F.least("new", "far").alias("comp"), "old"))
        label, changed = new.select("gid", "vid", "comp"), new.filter("comp <> old")
        if changed.isEmpty():
            return label


def filter_components(v: DataFrame, e: DataFrame, max_size: int, keep: str = "large") -> DataFrame:
    """Vertices of components above ``max_size`` ('large') or up to it ('small')."""
    sized = components(v, e).withColumn("size", F.count("*").over(Window.partitionBy("gid", "comp")))
    chosen = sized.filter(F.col("size") > max_size if keep == "large" else F.col("size") <= max_size)
    return v.join(chosen.select("gid", "vid"), ["gid", "vid"], "left_semi")


def by_size(e: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges, without loops, of the graphs that one task may hold, and those of larger ones, if there are any."""
    e = e.filter("src <> dst")
    large = save(e.groupBy("gid").count().filter(F.col("count") > LOCAL_EDGES).select("gid"))
    if large.isEmpty():
        return e, None
    return e.join(large, "gid", "left_anti"), e.join(large, "gid", "left_semi")


def edge_rings(e: DataFrame) -> DataFrame:
    """gid, eid, ring (vertices of a shortest cycle through the edge, sorted).

    Graphs of up to ``LOCAL_EDGES`` edges are searched many to a task.  In larger ones bridges are found first, in rounds that
    grow with the logarithm of the graph, and left out; the rest is searched by joins.
    """
    few, many = by_size(e)
    found = in_each_graph(packed_edges(few), lambda edges: [([i], ring) for i, ring in shortest_cycles(edges)])
    found = found.select("gid", F.col("eids")[0].alias("eid"), "ring")
    if many is not None:
        found = found.unionByName(searched_rings(many.join(ring_ids(many), ["gid", "eid"], "left_semi")))
    return save(found)


def cycle_basis(e: DataFrame) -> DataFrame:
    """gid, eids, ring: a smallest set of smallest rings of each graph, by their edges and vertices, both sorted.

    There are edges - vertices + components of them, and no other independent set of rings is shorter in all.  A graph of more
    than ``LOCAL_EDGES`` edges is cut at its bridges, and each block that is left is one task's work.
    """

    def basis(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
        return [(some, sorted({v for i in some for v in edges[i]})) for some in smallest_basis(edges)]

    few, many = by_size(e)
    packed = packed_edges(few)
    if many is not None:
        inner = save(many.join(ring_ids(many), ["gid", "eid"], "left_semi").select("gid", "eid", "src", "dst"))
        ends = inner.select("gid", F.explode(F.array("src", "dst")).alias("vid")).distinct()
        blocks = components(ends, inner).select("gid", F.col("vid").alias("src"), "comp")
        packed = packed.unionByName(packed_edges(inner.join(blocks, ["gid", "src"]), "comp"))
    return in_each_graph(packed, basis)


def searched_rings(e: DataFrame) -> DataFrame:
    """The rings of ``edge_rings`` by joins: both ends of an edge search breadth-first, a step at a time, in the graph without
    it.  Where the searches meet for the first time, shortest ways back to both ends make the rings.  A search holds each vertex
    once, so dense graphs do not make it grow, and it goes half way round only.
    """
    arcs = save(symmetrize(e.select("gid", "eid", "src", "dst")).filter("src <> dst"))
    step = arcs.select("gid", F.col("eid").alias("by"), F.col("src").alias("vid"), F.col("dst").alias("next"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("vid")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("vid"))))
    front = e.filter("src <> dst").select("gid", "eid", ends.alias("x")).select("gid", "eid", "x.side", "x.vid", F.lit(0).alias("d"))
    front = save(front)
    seen, mids, turn = front, None, 0
    while True:
        turn += 1
        grown = front.join(step, ["gid", "vid"]).filter("by <> eid").select("gid", "eid", "side", F.col("next").alias("vid")).distinct()
        front = save(grown.join(seen, ["gid", "eid", "side", "vid"], "left_anti").withColumn("d", F.lit(turn)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        other = seen.filter((F.col("side") == 1) & (F.col("d") >= turn - 1)).select("gid", "eid", "vid", F.col("d").alias("far"))
        met = front.filter("side = 0").join(other, ["gid", "eid", "vid"]).select("gid", "eid", "vid", "d", "far")
        met = save(met.withColumn("least", F.min("far").over(Window.partitionBy("gid", "eid"))).filter("far = least").drop("least"))
        mids = met if mids is None else mids.unionByName(met)
        front = front.join(met.select("gid", "eid").distinct(), ["gid", "eid"], "left_anti")
    if mids is None:
        return e.select("gid", "eid", F.array("src").alias("ring")).limit(0)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), "d"), F.struct(F.lit(1).alias("side"), F.col("far").alias("d"))))
    way = mids.select("gid", "eid", "vid", sides.alias("x")).select("gid", "eid", F.col("vid").alias("mid"), "x.side", F.col("vid"), "x.d", F.slice(F.array("vid"), 1, 0).alias("path"))
    ways = None
    for _ in range(turn + 1):
        way = save(way)
        done = way.filter("d = 0").select("gid", "eid", "mid", "side", "path")
        ways = done if ways is None else ways.unionByName(done)
        way = way.filter("d > 0")
        if way.isEmpty():
            break
        back = way.join(step, ["gid", "vid"]).filter("by <> eid").select("gid", "eid", "mid", "side", F.col("next").alias("vid"), (F.col("d") - 1).alias("d"), F.concat("path", F.array("next")).alias("path"))
        way = back.join(seen, ["gid", "eid", "side", "vid", "d"], "left_semi")
    a, b = (ways.filter(F.col("side") == i).select("gid", "eid", "mid", F.col("path").alias(f"path{i}")) for i in (0, 1))
    ring = F.array_sort(F.concat(F.array("mid"), "path0", "path1"))
    return save(a.join(b, ["gid", "eid", "mid"]).select("gid", "eid", ring.alias("ring")).distinct())


def rings(e: DataFrame) -> DataFrame:
    """gid, ring: the distinct rings."""
    return edge_rings(e).select("gid", "ring").distinct()


def inner_edges(e: DataFrame) -> DataFrame:
    """(gid, eid) of the edges that lie on rings."""
    few, many = by_size(e)
    found = in_each_graph(packed_edges(few), lambda edges: [([i], []) for i in on_cycles(edges)]).select("gid", F.col("eids")[0].alias("eid"))
    return found if many is None else found.unionByName(ring_ids(many))


def ring_edges(e: DataFrame) -> DataFrame:
    return e.join(inner_edges(e), ["gid", "eid"], "left_semi")


def bridge_edges(e: DataFrame) -> DataFrame:
    return e.join(inner_edges(e), ["gid", "eid"], "left_anti")


def merge_rings(r: DataFrame) -> DataFrame:
    """Rings that share more than two vertices are one, transitively."""
    numbered = save(r.withColumn("vid", F.row_number().over(Window.partitionBy("gid").orderBy("ring")) - 1))
    member = numbered.select("gid", "vid", F.explode("ring").alias("m"))
    other = member.select("gid", F.col("vid").alias("dst"), "m")
    links = member.withColumnRenamed("vid", "src").join(other, ["gid", "m"]).filter("src < dst").groupBy("gid", "src", "dst").count().filter("count > 2").select("gid", "src", "dst")
    comp = components(numbered.select("gid", "vid"), links)
    return numbered.join(comp, ["gid", "vid"]).groupBy("gid", "comp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ring")))).alias("ring")).select("gid", "ring")


def cliques(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, cid, kind (atom, bond, ring, joint), members: bonds outside rings, merged rings, vertices without edges, and the
    vertices where more than two bonds, two bonds and more, or more than two larger rings meet."""
    found = edge_rings(e)
    bonds = e.join(found.select("gid", "eid"), ["gid", "eid"], "left_anti").select("gid", F.lit("bond").alias("kind"), F.array("src", "dst").alias("members"))
    ring = merge_rings(found.select("gid", "ring").distinct()).select("gid", F.lit("ring").alias("kind"), F.col("ring").alias("members"))
    lone = degrees(v, e).filter("degree = 0").select("gid", F.lit("atom").alias("kind"), F.array("vid").alias("members"))
    base = save(bonds.unionByName(ring).unionByName(lone))
    at = base.select("gid", "kind", F.size("members").alias("size"), F.explode("members").alias("vid"))
    met = at.groupBy("gid", "vid").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "bond", 1)).alias("bonds"), F.count(F.when((F.col("kind") == "ring") & (F.col("size") > 4), 1)).alias("large"))
    joint = met.filter("n >= 2 AND (bonds > 2 OR (bonds = 2 AND n > 2) OR large > 2)").select("gid", F.lit("joint").alias("kind"), F.array("vid").alias("members"))
    w = Window.partitionBy("gid").orderBy("kind", "members")
    return save(base.unionByName(joint)).withColumn("cid", F.row_number().over(w) - 1).select("gid", "cid", "kind", "members")


def clique_graph(cl: DataFrame) -> DataFrame:
    """gid, c1, c2, w: cliques that share vertices, weighted by how many; a joint weighs 1 where bonds meet in it and 99
    where only rings do, and takes the place of the direct links of the cliques that meet there."""
    at = cl.select("gid", "cid", "kind", F.explode("members").alias("vid"))
    bonds = at.groupBy("gid", "vid").agg(F.count(F.when(F.col("kind") == "bond", 1)).alias("bonds"), F.count(F.when(F.col("kind") == "joint", 1)).alias("joints"))
    at = at.join(bonds, ["gid", "vid"])
    b = at.select("gid", "vid", F.col("cid").alias("c2"), F.col("kind").alias("k2"))
    pairs = at.withColumnsRenamed({"cid": "c1", "kind": "k1"}).join(b, ["gid", "vid"]).filter("c1 < c2")
    joint = (F.col("k1") == "joint") | (F.col("k2") == "joint")
    pairs = pairs.filter(joint | (F.col("joints") == 0))
    weight = F.max(F.when(joint, F.when(F.col("bonds") >= 2, 1).otherwise(99)))
    return pairs.groupBy("gid", "c1", "c2").agg(F.coalesce(weight, F.count("*")).cast("int").alias("w"))


def max_spanning_tree(ce: DataFrame) -> DataFrame:
    """The heaviest spanning forest of each graph (ties to smaller c1, then c2), by rounds in which every component takes
    its best edge."""
    edges = save(ce.select("gid", "c1", "c2", "w", F.col("c1").alias("a"), F.col("c2").alias("b")))
    chosen = None
    while not edges.isEmpty():
        rank = F.struct((-F.col("w")).alias("cost"), "c1", "c2", "w")
        sides = edges.select("gid", F.col("a").alias("x"), rank.alias("r")).unionByName(edges.select("gid", F.col("b").alias("x"), rank.alias("r")))
        best = save(sides.groupBy("gid", "x").agg(F.min("r").alias("r")).select("gid", "r.c1", "r.c2", "r.w").distinct())
        chosen = best if chosen is None else save(chosen.unionByName(best).distinct())
        ends = ce.select("gid", F.col("c1").alias("vid")).unionByName(ce.select("gid", F.col("c2").alias("vid"))).distinct()
        comp = components(ends, chosen.select("gid", F.col("c1").alias("src"), F.col("c2").alias("dst")))
        edges = save(
            ce.join(comp.select("gid", F.col("vid").alias("c1"), F.col("comp").alias("a")), ["gid", "c1"]).join(comp.select("gid", F.col("vid").alias("c2"), F.col("comp").alias("b")), ["gid", "c2"]).filter("a <> b").select("gid", "c1", "c2", "w", "a", "b")
        )
    return ce.limit(0) if chosen is None else chosen


def tree_nodes(cl: DataFrame, tree: DataFrame) -> DataFrame:
    """Cliques with their tree neighbours, is_leaf and is_root (the clique of vertex 0, or the first)."""
    near = tree.select("gid", F.col("c1").alias("cid"), F.col("c2").alias("other")).unionByName(tree.select("gid", F.col("c2").alias("cid"), F.col("c1").alias("other")))
    near = near.groupBy("gid", "cid").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))
    root = cl.groupBy("gid").agg(F.min(F.struct((~F.array_contains("members", 0)).alias("no"), "cid")).alias("r")).select("gid", F.col("r.cid").alias("root"))
    out = cl.join(near, ["gid", "cid"], "left").join(root, "gid")
    out = out.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<int>")))
    return out.select("gid", "cid", "kind", "members", "neighbours", (F.size("neighbours") <= 1).alias("is_leaf"), (F.col("cid") == F.col("root")).alias("is_root"))


def clique_context(cl: DataFrame, tree: DataFrame) -> DataFrame:
    """gid, cid, vid, owners: the vertices of a clique and its tree neighbours, each with the cliques that hold it."""
    near = tree.select("gid", F.col("c1").alias("cid"), F.col("c2").alias("other")).unionByName(tree.select("gid", F.col("c2").alias("cid"), F.col("c1").alias("other"))).unionByName(cl.select("gid", "cid", F.col("cid").alias("other")))
    member = cl.select("gid", F.col("cid").alias("other"), F.explode("members").alias("vid"))
    return near.join(member, ["gid", "other"]).groupBy("gid", "cid", "vid").agg(F.array_sort(F.collect_set("other")).alias("owners"))


def induced(v: DataFrame, e: DataFrame, members: DataFrame) -> DataFrame:
    """gid, cid with shape: what each set of members induces."""
    at = members.select("gid", "cid", F.explode("members").alias("vid"))
    vs = at.join(v, ["gid", "vid"])
    es = at.withColumnRenamed("vid", "src").join(e, ["gid", "src"]).join(at.withColumnRenamed("vid", "dst"), ["gid", "cid", "dst"])
    return shapes(vs, es, "gid", "cid")


def clique_labels(v: DataFrame, e: DataFrame, cl: DataFrame) -> DataFrame:
    """gid, cid, label: the canonical code of what each clique induces; codes are worked out once per distinct shape."""
    return with_codes(induced(v, e, cl)).select("gid", "cid", F.col("code").alias("label"))


def junction_tree_graphs(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, cliques): the junction trees as graphs to mine; labels are digests of clique codes, edges are '1'.
    Graphs that are alike have one tree, worked out once."""
    some = alike(v, e)
    cl = save(cliques(some.v, some.e))
    tree = max_spanning_tree(save(clique_graph(cl)))
    jv = save(clique_labels(some.v, some.e, cl).select("gid", F.col("cid").alias("vid"), F.md5("label").alias("vlb")))
    je = tree.select("gid", F.col("c1").alias("src"), F.col("c2").alias("dst"), F.lit("1").alias("elb"))
    je = je.withColumn("eid", F.row_number().over(Window.partitionBy("gid").orderBy("src", "dst")) - 1)
    return some.spread(jv), some.spread(save(je.select("gid", "eid", "src", "dst", "elb"))), some.spread(cl)


def recover_patterns(places: DataFrame, cl: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    """code, shape_code: mined tree patterns turned back into the vertices of their cliques, in the first graph that has
    them (each place there), as canonical codes."""
    first = places.groupBy("code").agg(F.min("gid").alias("gid"))
    held = places.join(first, ["code", "gid"]).select("code", "gid", F.array_sort("vids").alias("cids")).distinct()
    held = save(held.withColumn("cid", F.row_number().over(Window.partitionBy("gid").orderBy("code", "cids"))))
    member = held.select("code", "gid", "cid", F.explode("cids").alias("c")).join(cl.select("gid", F.col("cid").alias("c"), "members"), ["gid", "c"])
    whole = member.groupBy("code", "gid", "cid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    named = with_codes(induced(v, e, whole)).withColumnRenamed("code", "shape_code")
    return named.join(held.select("gid", "cid", "code"), ["gid", "cid"]).select("code", "shape_code").distinct()
