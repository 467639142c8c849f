"""Frequent connected patterns of a set of labelled graphs, and matching of given patterns.

Growth is level by level.  Labels are numbers, and a pattern found frequent gets a number, so an embedding is that number, its
graph, and its vertices and edges; it meets its whole graph in one join, in which it takes every step that it may, so neither
the embeddings nor the edges are shuffled once for each growing point.  Then steps are counted, and the new patterns that are
frequent are tested for minimality on their distinct codes alone.  Embeddings are never gathered per pattern, so a pattern
that occurs in a third of all graphs is no one task's work.  All of this is done for one graph of those that are alike, which
counts as many times as there are of them; places are given to all of them where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphset.operators.alike import alike
from graphset.operators.codes import arcs_of_udf, escaped, extensions_udf, graph_of, is_min_key_udf, unescaped
from graphset.operators.tables import symmetrize, with_labels
from graphset.storage import numbered, save, small

#: Graphs with more edges than this, read from both ends, are kept as one row an edge while patterns grow.
ARCS_IN_ROW = 2_000


@dataclass(frozen=True)
class MiningConfig:
    min_support: int
    min_vertices: int = 2
    max_vertices: int | None = None
    max_edges: int | None = None
    directed: bool = False


def frequent_vertex_labels(v: DataFrame, min_support: int) -> DataFrame:
    """vlb, support: the number of graphs that hold the label."""
    return v.groupBy("vlb").agg(F.countDistinct("gid").alias("support")).filter(F.col("support") >= min_support)


def frequent_edges(v: DataFrame, e: DataFrame, min_support: int, directed: bool = False) -> DataFrame:
    """vlb1, elb, vlb2 (vlb1 <= vlb2 unless directed), support (graphs), embeddings (both readings if labels are equal)."""
    arcs = with_labels(v, e if directed else symmetrize(e))
    arcs = arcs if directed else arcs.filter("slb <= dlb")
    one = arcs.groupBy("gid", F.col("slb").alias("vlb1"), "elb", F.col("dlb").alias("vlb2")).agg(F.count("*").alias("n"))
    return one.groupBy("vlb1", "elb", "vlb2").agg(F.count("*").alias("support"), F.sum("n").alias("embeddings")).filter(F.col("support") >= min_support)


def match_pattern(v: DataFrame, e: DataFrame, code: str, directed: bool = False) -> DataFrame:
    """gid, vids: every injective, label-preserving place of the pattern with this code (automorphic images counted apart)."""
    labels, edges = graph_of(code)
    arcs = with_labels(v, e if directed else symmetrize(e)).select("gid", "src", "dst", "elb", "slb", "dlb")
    found: DataFrame | None = None
    seen: list[int] = []
    for a, b, lab in edges:
        wanted = F.col("slb").eqNullSafe(labels[a]) & F.col("elb").eqNullSafe(lab) & F.col("dlb").eqNullSafe(labels[b])
        step = arcs.filter(wanted).select("gid", F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))
        found = step if found is None else found.join(step, ["gid", *(f"v{x}" for x in (a, b) if x in seen)])
        for x in (a, b):
            if x not in seen:
                for y in seen:
                    found = found.filter(F.col(f"v{x}") != F.col(f"v{y}"))
                seen.append(x)
    return found.select("gid", F.array(*(F.col(f"v{x}") for x in sorted(seen))).alias("vids"))


def growth_arcs(v: DataFrame, e: DataFrame, min_support: int, directed: bool) -> tuple[DataFrame, DataFrame]:
    """(arcs, names): gid, weight, eid, src, dst, sl, el, dl, kind of the frequent edges, read from both ends; id, field of the
    labels.  Edges carry the weight of their graph, which counts as so many.

    Labels are numbered in their order, null first.  In directed graphs ``el`` is the number plus 1, negative if the arc is read
    against its direction.  ``kind`` is the least reading of the edge: no step of a minimal code is of a lesser kind than its
    first.
    """
    one = with_labels(v, e).select("gid", "weight", "eid", "src", "dst", "slb", "elb", "dlb")
    swap = F.lit(False) if directed else (F.col("slb").isNotNull() & F.col("dlb").isNull()) | F.coalesce(F.col("dlb") < F.col("slb"), F.lit(False))
    one = save(one.select("gid", "weight", "eid", swap.alias("swap"), *(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("src", "dst", "a"), ("dst", "src", "b"), ("slb", "dlb", "x"), ("dlb", "slb", "z"))), F.col("elb").alias("y")))
    common = save(one.groupBy("x", "y", "z", "gid").agg(F.first("weight").alias("weight")).groupBy("x", "y", "z").agg(F.sum("weight").alias("count")).filter(F.col("count") >= min_support).drop("count"))
    labels = common.select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.col(c).alias("label")) for c, k in (("x", 0), ("z", 0), ("y", 1))))).alias("l")).select("l.*").distinct()
    names = save(numbered(labels, "what", "label", name="id").withColumn("id", F.col("id").cast("int")))
    kinds = common
    for c, what in (("x", 0), ("y", 1), ("z", 0)):
        of = small(names.filter(F.col("what") == what).select(F.col("label").alias("of"), F.col("id").alias(f"n{c}")))
        kinds = kinds.join(of, F.col(c).eqNullSafe(F.col("of"))).drop("of")
    kinds = small(kinds.withColumnsRenamed({c: f"of_{c}" for c in "xyz"}))
    one = one.join(kinds, F.col("x").eqNullSafe(F.col("of_x")) & F.col("y").eqNullSafe(F.col("of_y")) & F.col("z").eqNullSafe(F.col("of_z")))
    kind = F.struct(F.least("nx", "nz").alias("x"), (F.lit(directed) & (F.col("nx") < F.col("nz"))).cast("int").alias("s"), F.col("ny").alias("y"), F.greatest("nx", "nz").alias("z")).alias("kind")
    there, back = (F.col("ny") + 1, -F.col("ny") - 1) if directed else (F.col("ny"), F.col("ny"))
    ways = F.array(*(F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(x).alias("sl"), el.alias("el"), F.col(z).alias("dl")) for s, d, x, el, z in (("a", "b", "nx", there, "nz"), ("b", "a", "nz", back, "nx"))))
    arcs = one.select("gid", "weight", "eid", kind, F.explode(ways).alias("way")).select("gid", "weight", "eid", "way.*", "kind")
    return save(arcs), names.select("id", escaped(F.col("label")).alias("field"))


def _grown(places: DataFrame, arcs: DataFrame, packed: DataFrame, large: DataFrame | None, most_v: int | None) -> DataFrame:
    """All steps that places (with points, n and root of their pattern) can take: one row each."""

    def fits(p: Column, q: Column, a: Callable[[str], Column]) -> Column:
        new = q.isNull() & ~F.array_contains("vids", a("dst"))
        if most_v is not None:
            new = new & (F.col("n") < most_v)
        back = q.isNotNull() & (a("dst") == F.get("vids", q)) & ~F.array_contains("eids", a("eid"))
        return (a("src") == F.get("vids", p)) & (a("kind") >= F.col("root")) & (new | back)

    def steps(point: Column) -> Column:
        p, q = point["p"], point["q"]
        found = F.filter("arcs", lambda a: fits(p, q, a.getField))
        return F.transform(found, lambda a: F.struct(p.alias("p"), F.coalesce(q, F.col("n")).alias("t"), a["sl"].alias("sl"), a["el"].alias("el"), a["dl"].alias("dl"), a["dst"].alias("dst"), a["eid"].alias("eid")))

    out = ["pid", "gid", "weight", "vids", "eids"]
    grown = places.join(packed, "gid").select(*out, F.explode(F.flatten(F.transform("points", steps))).alias("step")).select(*out, "step.*")
    if large is not None:
        points = places.join(large, "gid", "left_semi").withColumn("point", F.explode("points")).select("*", "point.p", "point.q")
        edges = arcs.drop("weight").join(large, "gid", "left_semi").withColumnRenamed("src", "from")
        on = points.withColumn("from", F.get("vids", F.col("p"))).join(edges, ["gid", "from"]).withColumn("src", F.col("from"))
        on = on.filter(fits(F.col("p"), F.col("q"), F.col)).withColumn("t", F.coalesce("q", "n"))
        grown = grown.unionByName(on.select(*out, "p", "t", "sl", "el", "dl", "dst", "eid"))
    vids = F.when(F.col("t") > F.col("p"), F.concat("vids", F.array("dst"))).otherwise(F.col("vids"))
    return grown.select(F.col("pid").alias("parent"), "p", "t", "sl", "el", "dl", "gid", "weight", vids.alias("vids"), F.concat("eids", F.array("eid")).alias("eids"))


def mine_frequent(v: DataFrame, e: DataFrame, config: MiningConfig) -> tuple[DataFrame, DataFrame]:
    """(patterns, embeddings): code, support, embeddings, num_vert, num_edge; and code, gid, vids, eids of each place.

    The upper bounds stop growth, the lower bound only the report.  One-vertex patterns are reported when the lower bound
    allows, with the label as code.  Labels may be any text or null; in codes they are written as ``codes`` says.  Directed
    patterns are mined in the same way over steps that know their direction; their codes list the arcs from tail to head, and
    two vertices may have several arcs.  Loops are not part of patterns.
    """
    directed = config.directed
    most_v = None if config.max_vertices is None else max(config.max_vertices, config.min_vertices)
    some = alike(v.select("gid", "vid", "vlb"), e.filter("src <> dst").select("gid", "eid", "src", "dst", "elb"))
    arcs, names = growth_arcs(some.v, some.e.join(some.sizes, "gid"), config.min_support, directed)
    names = small(names)
    large = save(arcs.groupBy("gid").count().filter(F.col("count") > ARCS_IN_ROW).select("gid"))
    large = None if large.isEmpty() else large
    rows = arcs if large is None else arcs.join(large, "gid", "left_anti")
    packed = save(rows.groupBy("gid").agg(F.collect_list(F.struct("src", "dst", "eid", "sl", "el", "dl", "kind")).alias("arcs")))
    minimal, ways = is_min_key_udf(directed), extensions_udf(directed)
    step = ["parent", "p", "t", "sl", "el", "dl"]
    sign = F.when(F.lit(not directed), "").when(F.col("el") > 0, ">").otherwise("<")
    number = F.abs("el") - 1 if directed else F.col("el")
    first = F.struct(F.col("sl").alias("x"), (F.lit(directed) & (F.col("el") > 0)).cast("int").alias("s"), number.alias("y"), F.col("dl").alias("z"))
    level = arcs.filter("sl <= dl").select(F.lit(0).cast("long").alias("parent"), F.lit(0).alias("p"), F.lit(1).alias("t"), "sl", "el", "dl", "gid", "weight", F.array("src", "dst").alias("vids"), F.array("eid").alias("eids"))
    parents, all_patterns, all_places = None, None, None
    edges = 1
    while True:
        # kept while it is counted; what is infrequent is never written
        level = level.persist(StorageLevel.MEMORY_AND_DISK)
        counts = level.groupBy(*step, "gid").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).groupBy(*step).agg(F.sum("weight").alias("support"), F.sum(F.col("n") * F.col("weight")).alias("embeddings"))
        counts = counts.filter(F.col("support") >= config.min_support).withColumn("number", number)
        for c, of in (("sl", "x"), ("number", "y"), ("dl", "z")):
            counts = counts.join(names.select(F.col("id").alias(c), F.col("field").alias(of)), c)
        own_key = F.concat_ws(",", "p", "t", "sl", F.concat(sign, "number"), "dl")
        own_code = F.concat_ws(",", "p", "t", "x", F.concat(sign, "y"), "z")
        if parents is None:
            counts = counts.select(*step, "support", "embeddings", own_key.alias("key"), own_code.alias("code"), F.lit(2).alias("num_vert"), first.alias("root"))
        else:
            counts = counts.join(parents, "parent").select(*step, "support", "embeddings", F.concat_ws(";", "before_key", own_key).alias("key"), F.concat_ws(";", "before_code", own_code).alias("code"), (F.col("before_vert") + (F.col("t") > F.col("p")).cast("int")).alias("num_vert"), "root")
        found = save(counts.filter(minimal("key")).withColumns({"pid": F.monotonically_increasing_id(), "num_edge": F.lit(edges)}))
        if all_patterns is not None and found.isEmpty():
            level.unpersist()
            break
        kept = save(level.join(found.select("pid", *step), step).select("pid", "gid", "weight", "vids", "eids"))
        level.unpersist()
        patterns = found.select("pid", "code", "support", "embeddings", "num_vert", "num_edge")
        places = kept.drop("weight").withColumn("num_edge", F.lit(edges))
        all_patterns = patterns if all_patterns is None else all_patterns.unionByName(patterns)
        all_places = places if all_places is None else all_places.unionByName(places)
        if config.max_edges is not None and edges >= config.max_edges or found.isEmpty():
            break
        points = save(found.select("pid", ways("key").alias("points"), F.col("num_vert").alias("n"), "root"))
        parents = found.select(F.col("pid").alias("parent"), F.col("key").alias("before_key"), F.col("code").alias("before_code"), F.col("num_vert").alias("before_vert"), "root")
        level = _grown(kept.join(points, "pid"), arcs, packed, large, most_v)
        edges += 1
    all_places = some.spread(all_places.join(all_patterns.select("num_edge", "pid", "code"), ["num_edge", "pid"]).select("code", "gid", "vids", "eids"))
    all_patterns = all_patterns.drop("pid")
    if directed:
        turned = save(all_patterns.select("code", arcs_of_udf("code").alias("x")).select("code", "x.arcs", "x.order"))
        columns = all_patterns.columns, all_places.columns
        all_patterns = all_patterns.join(turned, "code").withColumn("code", F.col("arcs")).select(*columns[0])
        vids = F.transform("order", lambda i: F.element_at("vids", i + 1))
        all_places = all_places.join(turned, "code").withColumns({"code": F.col("arcs"), "vids": vids}).select(*columns[1])
    if config.min_vertices <= 1:
        lone = some.v.groupBy("vlb", "gid").agg(F.count("*").alias("n")).join(some.sizes, "gid")
        lone = lone.groupBy("vlb").agg(F.sum("weight").alias("support"), F.sum(F.col("n") * F.col("weight")).alias("embeddings")).filter(F.col("support") >= config.min_support)
        lone = lone.select(escaped(F.col("vlb")).alias("code"), "support", "embeddings", F.lit(1).alias("num_vert"), F.lit(0).alias("num_edge"))
        all_patterns = all_patterns.unionByName(lone)
    return all_patterns.filter(F.col("num_vert") >= config.min_vertices), all_places


def occurrences(places: DataFrame) -> DataFrame:
    """code, gid, n: how often each pattern lies in each graph."""
    return places.groupBy("code", "gid").agg(F.count("*").alias("n"))


def where(occ: DataFrame, code: str) -> DataFrame:
    """The graphs that contain a pattern."""
    return occ.filter(F.col("code") == code).select("gid")


def describe(patterns: DataFrame) -> DataFrame:
    """Patterns with a description ``v id label … e from to label …``."""
    steps = F.transform(F.split("code", ";"), lambda s: F.split(s, ","))
    ends = F.flatten(F.transform(steps, lambda s: F.array(F.struct(s[0].cast("int").alias("i"), s[2].alias("l")), F.struct(s[1].cast("int").alias("i"), s[4].alias("l")))))
    vs = F.transform(F.array_sort(F.array_distinct(ends)), lambda x: F.concat_ws(" ", F.lit("v"), x["i"], x["l"]))
    es = F.transform(steps, lambda s: F.concat_ws(" ", F.lit("e"), s[0], s[1], s[3]))
    return patterns.withColumn("description", F.when(F.col("num_edge") > 0, F.array_join(F.concat(vs, es), " ")).otherwise(F.concat_ws(" ", F.lit("v 0"), "code")))


def code_to_graph(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pattern graphs as tables: (code, vid, vlb) and (code, eid, src, dst, elb), with the labels as they were."""
    step = patterns.filter("num_edge > 0").select("code", F.posexplode(F.split("code", ";")).alias("eid", "s")).withColumn("s", F.split("s", ","))
    ends = step.select("code", F.explode(F.array(F.struct(F.col("s")[0].cast("int").alias("vid"), unescaped(F.col("s")[2]).alias("vlb")), F.struct(F.col("s")[1].cast("int").alias("vid"), unescaped(F.col("s")[4]).alias("vlb")))).alias("x"))
    return ends.select("code", "x.*").distinct(), step.select("code", "eid", F.col("s")[0].cast("int").alias("src"), F.col("s")[1].cast("int").alias("dst"), unescaped(F.col("s")[3]).alias("elb"))


def pattern_vectors(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """gid, at, n: the pattern counts of each graph as a sparse vector over all patterns, numbered by code."""
    places = numbered(patterns.select("code").distinct(), "code", name="at")
    rows = occ.join(places, "code").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("x"))
    return rows.select("gid", F.col("x.at").alias("at"), F.col("x.n").alias("n"))


def hstack(left: DataFrame, right: DataFrame, key: str = "gid") -> DataFrame:
    """The feature columns of both tables side by side, by key; a key that one side lacks has nulls there."""
    return left.join(right, key, "full")


def pattern_matrix(occ: DataFrame, codes: list[str]) -> DataFrame:
    """gid and one count column p0, p1, … for each of the given codes."""
    return occ.filter(F.col("code").isin(codes)).groupBy("gid").agg(*(F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0)).alias(f"p{i}") for i, c in enumerate(codes)))


def top_patterns(patterns: DataFrame, k: int) -> DataFrame:
    return patterns.orderBy(F.desc("support"), "code").limit(k)
