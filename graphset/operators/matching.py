"""Places of one pattern in all graphs: each symmetric place once, and the largest parts that fit where the whole does not.

A pattern is a code (see ``codes``); it is small, and what follows from its symmetry is worked out once, before the graphs are
looked at.  Graphs are then joined step by step, the rarest edge of the pattern first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.operators.codes import Label, graph_of
from graphset.operators.tables import symmetrize, with_labels
from graphset.storage import save

Edge = tuple[int, int, Label]


def _extends(labels: dict[int, Label], near: dict[int, dict[int, tuple]], image: dict[int, int]) -> bool:
    """Whether a map of some vertices can be carried on to an automorphism."""
    if any(near[x].get(y) != near[image[x]].get(image[y]) for x in image for y in image):
        return False
    rest = [x for x in labels if x not in image]
    if not rest:
        return True
    # a vertex beside those that are mapped already has few images
    x = max(rest, key=lambda v: sum(w in image for w in near[v]))
    free = set(labels) - set(image.values())
    for y in free:
        if labels[x] == labels[y] and len(near[x]) == len(near[y]) and all(near[y].get(image[w]) == lab for w, lab in near[x].items() if w in image) and _extends(labels, near, image | {x: y}):
            return True
    return False


def symmetry(labels: dict[int, Label], edges: list[Edge], directed: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """The number of automorphisms, and pairs (x, y): of all symmetric places, just one has x before y for every pair.

    Vertices are fixed one after another; each comes before all that it could still be exchanged with.
    """
    near: dict[int, dict[int, tuple]] = {v: {} for v in labels}
    for a, b, lab in edges:
        for u, w, way in ((a, b, 1), (b, a, -1)):
            near[u][w] = tuple(sorted([*near[u].get(w, ()), (way if directed else 0, lab is not None, lab or "")]))
    fixed: dict[int, int] = {}
    number, before = 1, []
    for x in sorted(labels):
        orbit = [y for y in sorted(labels) if y not in fixed and labels[x] == labels[y] and _extends(labels, near, fixed | {x: y})]
        before += [(x, y) for y in orbit if y != x]
        number *= len(orbit)
        fixed[x] = x
    return number, before


def _labelled_arcs(v: DataFrame, e: DataFrame, directed: bool) -> DataFrame:
    return with_labels(v, e if directed else symmetrize(e)).select("gid", "src", "dst", "elb", "slb", "dlb")


def _is(labels: dict[int, Label], edge: Edge) -> Column:
    a, b, lab = edge
    return F.col("slb").eqNullSafe(labels[a]) & F.col("elb").eqNullSafe(lab) & F.col("dlb").eqNullSafe(labels[b])


def _in_order(edges: list[Edge], often: dict[Edge, int]) -> Iterable[Edge]:
    """The rarest edge, then always the rarest that is joined to those before it."""
    rest, seen = list(edges), set()
    while rest:
        # an edge between vertices that are there already only takes places away
        edge = min((x for x in rest if not seen or seen & {*x[:2]}), key=lambda x: (not {*x[:2]} <= seen, often[x]))
        rest.remove(edge)
        seen |= {*edge[:2]}
        yield edge


def match_once(v: DataFrame, e: DataFrame, code: str, directed: bool = False) -> DataFrame:
    """gid, vids: every place of a connected pattern, those that differ by a symmetry of the pattern once.

    Order conditions go into the joins as soon as both vertices are there, so symmetric places are never made.
    """
    labels, edges = graph_of(code)
    arcs = save(_labelled_arcs(v, e, directed))
    # a row for each edge of the pattern
    counts = arcs.agg(*(F.count(F.when(_is(labels, x), 1)) for x in edges)).first()
    _, before = symmetry(labels, edges, directed)
    found: DataFrame | None = None
    seen: list[int] = []
    for a, b, lab in _in_order(edges, dict(zip(edges, counts, strict=True))):
        step = arcs.filter(_is(labels, (a, b, lab))).select("gid", F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}")).distinct()
        found = step if found is None else found.join(step, ["gid", *(f"v{x}" for x in (a, b) if x in seen)])
        for x in (a, b):
            if x not in seen:
                for y in seen:
                    found = found.filter(F.col(f"v{x}") != F.col(f"v{y}"))
                seen.append(x)
                for p, q in before:
                    if x in (p, q) and p in seen and q in seen:
                        found = found.filter(F.col(f"v{p}") < F.col(f"v{q}"))
    return found.select("gid", F.array(*(F.col(f"v{x}") for x in sorted(seen))).alias("vids"))


def _parts(labels: dict[int, Label], edges: list[Edge]) -> dict[frozenset[int], tuple[frozenset[int], int] | None]:
    """Connected parts of the pattern by their vertices, each with the part, and the vertex more, that it grows from."""
    near: dict[int, set[int]] = {v: set() for v in labels}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    level = {frozenset([x]): None for x in labels}
    out: dict[frozenset[int], tuple[frozenset[int], int] | None] = dict(level)
    while level:
        grown = {}
        for part in level:
            for x in sorted(set().union(*(near[y] for y in part)) - part):
                grown.setdefault(part | {x}, (part, x))
        out |= grown
        level = grown
    return out


def largest_common(v: DataFrame, e: DataFrame, code: str) -> DataFrame:
    """gid, size, vids: the largest connected parts of an undirected pattern that each graph holds, one row for each set of its
    vertices; ``vids`` has the vertices by the pattern's numbers, null for those left out (of several ways the least).

    A part is a set of the pattern's vertices with all edges between them.  All parts of one size grow from those one smaller
    in one join, in which a graph takes part as long as it holds any.  The number of parts grows fast with the pattern's size,
    not with the data.
    """
    spark = v.sparkSession
    labels, edges = graph_of(code)
    parts = _parts(labels, edges)
    number = {part: i for i, part in enumerate(parts)}
    arcs = save(_labelled_arcs(v, e, False).select("gid", "src", F.struct("dst", "elb", "dlb").alias("arc")))
    vid = v.schema["vid"].dataType
    size = max(labels) + 1

    def placed(x: int, at: Column) -> Column:
        return F.array(*(at.cast(vid) if y == x else F.lit(None).cast(vid) for y in range(size)))

    level: DataFrame | None = None
    for x in sorted(labels):
        own = v.filter(F.col("vlb").eqNullSafe(labels[x])).select("gid", F.lit(number[frozenset([x])]).alias("part"), placed(x, F.col("vid")).alias("vids"))
        level = own if level is None else level.unionByName(own)
    level = save(level)
    levels = [level]
    kinds = T.StructType([T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("to", T.IntegerType()), ("x", T.IntegerType()), ("vlb", T.StringType()), ("anchor", T.IntegerType()), ("elb", T.StringType()), ("others", T.ArrayType(T.StructType([T.StructField("y", T.IntegerType()), T.StructField("elb", T.StringType())]))))])
    for n in range(2, len(labels) + 1):
        steps = []
        for part, grows in parts.items():
            if len(part) == n:
                smaller, x = grows
                links = [(b if a == x else a, lab) for a, b, lab in edges if (a == x and b in smaller) or (b == x and a in smaller)]
                steps.append((number[smaller], number[part], x, labels[x], *links[0], links[1:]))
        if not steps:
            break
        # a row for each part of the pattern
        at = level.join(F.broadcast(spark.createDataFrame(steps, kinds)), "part").withColumn("src", F.get("vids", F.col("anchor")))
        near = arcs.select("gid", "src", "arc.*")
        grown = at.withColumnRenamed("elb", "wanted").join(near, ["gid", "src"]).filter(F.col("elb").eqNullSafe(F.col("wanted")) & F.col("dlb").eqNullSafe(F.col("vlb")))
        grown = grown.filter(~F.exists("vids", lambda y: F.coalesce(y == F.col("dst"), F.lit(False))))
        links = F.transform("others", lambda o: F.struct(F.get("vids", o["y"]).alias("dst"), o["elb"].alias("elb")))
        grown = grown.select("gid", F.col("to").alias("part"), F.transform("vids", lambda y, i: F.when(i == F.col("x"), F.col("dst")).otherwise(y)).alias("vids"), F.col("dst").alias("src"), links.alias("links"))
        done = grown.filter(F.size("links") == 0).select("gid", "part", "vids")
        # further edges of the new vertex must be there as well
        rest = grown.filter(F.size("links") > 0).withColumns({"row": F.monotonically_increasing_id(), "open": F.size("links")})
        rest = save(rest)
        have = rest.select("row", "gid", "src", F.explode("links").alias("l")).select("row", "gid", "src", "l.dst", F.col("l.elb").alias("wanted"))
        have = have.join(near.select("gid", "src", "dst", "elb").distinct(), ["gid", "src", "dst"]).filter(F.col("elb").eqNullSafe(F.col("wanted"))).groupBy("row").agg(F.count("*").alias("met"))
        level = save(done.unionByName(rest.join(have, "row").filter("met = open").select("gid", "part", "vids")).distinct())
        if level.isEmpty():
            break
        levels.append(level)
    sized = [df.withColumn("size", F.lit(k + 1)) for k, df in enumerate(levels)]
    whole = sized[0]
    for more in sized[1:]:
        whole = whole.unionByName(more)
    most = save(whole.groupBy("gid").agg(F.max("size").alias("size")))
    held = whole.join(most, ["gid", "size"])
    members = F.array_sort(F.filter("vids", lambda x: x.isNotNull()))
    return held.groupBy("gid", "size", members.alias("members")).agg(F.min("vids").alias("vids")).select("gid", "size", "vids")
