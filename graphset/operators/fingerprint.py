"""Neighbourhood identifiers, environments, sentences and similarity."""

from __future__ import annotations

from functools import reduce
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.operators.tables import symmetrize
from graphset.storage import numbered, save, small

#: Identifiers that sets must share at once to meet, at most, and ways to choose them among the rarest of a set at most.
TOGETHER, KEYS = 3, 200


def identifiers(v: DataFrame, e: DataFrame, radius: int) -> DataFrame:
    """gid, vid, r, id: the label at radius 0, then the md5 of the own id and the sorted (edge label, neighbour id) pairs."""
    arcs = symmetrize(e.select("gid", "src", "dst", "elb"))
    now = v.select("gid", "vid", F.md5("vlb").alias("id"))
    out = now.withColumn("r", F.lit(0))
    for r in range(1, radius + 1):
        near = arcs.join(now.select("gid", F.col("vid").alias("dst"), F.col("id").alias("nid")), ["gid", "dst"])
        near = near.groupBy("gid", F.col("src").alias("vid")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "elb", "nid"))), ",").alias("around"))
        now = now.join(near, ["gid", "vid"], "left").select("gid", "vid", F.md5(F.concat_ws("|", "id", F.coalesce("around", F.lit("")))).alias("id"))
        out = out.unionByName(now.withColumn("r", F.lit(r)))
    return out.select("gid", "vid", "r", "id")


def neighborhood(v: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """gid, vid, near: all vertices within k steps, the vertex itself included."""
    arcs = symmetrize(e.select("gid", "src", "dst"))
    ball = v.select("gid", "vid", F.col("vid").alias("near"))
    for _ in range(k):
        far = ball.join(arcs.select("gid", F.col("src").alias("near"), "dst"), ["gid", "near"]).select("gid", "vid", F.col("dst").alias("near"))
        ball = ball.unionByName(far).distinct()
    return ball


def ball_edges(v: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """gid, vid, edges: the sorted ids of the edges within k steps of each vertex (those with an end within k - 1)."""
    inner = neighborhood(v, e, k - 1)
    arcs = symmetrize(e.select("gid", "eid", "src", "dst")).select("gid", F.col("src").alias("near"), "eid")
    return inner.join(arcs, ["gid", "near"]).groupBy("gid", "vid").agg(F.array_sort(F.collect_set("eid")).alias("edges"))


def dedup_environments(ids: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    """Of the identifiers of one graph that cover the same edges only the first by (r, id, vid) stays; radius 0 stays."""
    radius = ids.agg(F.max("r")).first()[0] or 0
    balls = None
    for r in range(1, radius + 1):
        b = ball_edges(v, e, r).withColumn("r", F.lit(r))
        balls = b if balls is None else balls.unionByName(b)
    if balls is None:
        return ids
    rest = ids.filter("r > 0").join(balls, ["gid", "vid", "r"])
    first = F.row_number().over(Window.partitionBy("gid", "edges").orderBy("r", "id", "vid"))
    return ids.filter("r = 0").unionByName(rest.withColumn("k", first).filter("k = 1").select(*ids.columns))


def sentences(ids: DataFrame, kind: str = "alternating") -> DataFrame:
    """Tokens by vertex, then radius: one sentence per graph ('alternating'), or one per graph and radius ('per_radius')."""
    keys = ["gid"] if kind == "alternating" else ["gid", "r"]
    return ids.filter("id IS NOT NULL").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "r", "id"))), lambda x: x["id"]).alias("tokens"))


def locate(ids: DataFrame, token: str) -> DataFrame:
    """gid, vid, r where an identifier stands."""
    return ids.filter(F.col("id") == token).select("gid", "vid", "r")


def wl_features(v: DataFrame, e: DataFrame, h: int) -> DataFrame:
    """gid, id, n: Weisfeiler-Lehman subtree counts over radius 0..h."""
    return identifiers(v, e, h).groupBy("gid", "id").agg(F.count("*").alias("n"))


def first_occurrence(ids: DataFrame) -> DataFrame:
    """id, gid: the first graph that holds each identifier."""
    return ids.groupBy("id").agg(F.min("gid").alias("gid"))


def tanimoto(fp: DataFrame, target: DataFrame) -> DataFrame:
    """gid, similarity of each graph's distinct identifiers (gid, id) to a target's (id)."""
    t = target.select("id").distinct()
    size = t.count()
    own = fp.select("gid", "id").distinct()
    n = own.groupBy("gid").agg(F.count("*").alias("n"))
    both = own.join(t, "id", "left_semi").groupBy("gid").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    return n.join(both, "gid", "left").select("gid", (c / (F.col("n") + size - c)).alias("similarity"))


def similar_classes(fp: DataFrame) -> DataFrame:
    """gid, class of every graph: the smallest gid among the graphs with an equal identifier set."""
    sets = fp.select("gid", "id").distinct().groupBy("gid").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    least = sets.groupBy("ids").agg(F.min("gid").alias("class"))
    return sets.join(least, "ids").select("gid", "class")


def _choices(n: Column, k: int) -> Column:
    """How many sets of ``k`` things ``n`` things have."""
    return reduce(mul, [n - i for i in range(k)]) / factorial(k)


def _keys(head: Column, size: Column, before: Column, k: int) -> Column:
    """Every ``k`` numbers of the array ``head`` as one key, with the place of the last of them, of which the first is ``before`` + 1."""

    def chosen(rest: Column, place: Column, taken: list[Column]) -> Column:
        def add(x: Column, i: Column) -> Column:
            at = place + i + 1
            if len(taken) + 1 == k:
                return F.struct(F.xxhash64(size, *taken, x).alias("key"), at.alias("last"))
            return chosen(F.slice(rest, i + 2, F.size(rest)), at, [*taken, x])

        found = F.transform(rest, add)
        return found if len(taken) + 1 == k else F.flatten(found)

    return chosen(head, before, [])


def similar_pairs(fp: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of graphs whose identifier sets reach the threshold.  Graphs with equal sets are compared once: a and
    b are the smallest gids of their classes, and pairs inside a class are left out; ``similar_classes`` has the members.

    Sets of the sizes x >= y reach it with c = ceil(t (x + y) / (1 + t)) identifiers in common, and then the first k <= c of these, by
    rarity, are among the first x - c + k and y - c + k of theirs.  So sets meet only where they share k of their rarest identifiers at
    once: three, or fewer where sets are so small that c is, or so large that there are more than ``KEYS`` ways to choose them.  And a set
    asks only for sets of the sizes that can still reach the threshold.
    """
    sets = fp.select("gid", "id").distinct().groupBy("gid").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = save(sets.groupBy("ids").agg(F.min("gid").alias("g")))
    item = classes.select("g", F.explode("ids").alias("id"))
    numbers = small(numbered(item.groupBy("id").agg(F.count("*").alias("df")), "df", "id", name="x"))
    # numbers in order of rarity; those that no other set has come first
    ordered = item.join(numbers, "id").groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count_if(F.col("df") == 1).cast("int").alias("own"))
    ordered = save(ordered.withColumn("n", F.size("xs")))

    def common(x: Column, y: Column) -> Column:
        return F.greatest(F.ceil((x + y) * (threshold / (1 + threshold)) - 1e-9), F.lit(1)).cast("int")

    size = F.col("size")
    spare = size - common(size, size)
    # how many identifiers two sets must share at once, of which the smaller one has this size
    k = F.lit(1)
    for more in range(2, TOGETHER + 1):
        k = F.when((common(size, size) >= more) & (_choices(spare + more, more) <= KEYS), more).otherwise(k)

    def keyed(rows: DataFrame, place: Column) -> DataFrame:
        """``rows`` with k, and key and last of every choice of k among the first ``place`` + k identifiers of a set that others have."""
        rows = rows.withColumn("k", k).withColumn("head", F.slice("xs", F.col("own") + 1, F.greatest(place + F.col("k") - F.col("own"), F.lit(0))))
        ways = F.lit(None)
        for m in range(1, TOGETHER + 1):
            ways = F.when(F.col("k") == m, _keys(F.col("head"), size, F.col("own"), m)).otherwise(ways)
        return rows.withColumn("way", F.explode(ways)).select("*", "way.key", "way.last")

    has = keyed(ordered.withColumn("size", F.col("n")), spare).select("key", F.col("g").alias("y"), "last")
    asks = ordered.withColumn("size", F.explode(F.sequence(F.greatest(F.ceil(F.col("n") * threshold - 1e-9), F.lit(1)).cast("int"), F.col("n"))))
    asks = keyed(asks, F.col("n") - common(F.col("n"), size))
    asks = asks.select("key", F.col("g").alias("x"), (F.col("n") == size).alias("even"), (size - common(F.col("n"), size) + F.col("k")).alias("most"))
    # sets of one size ask for each other
    met = asks.join(has, "key").filter((F.col("last") <= F.col("most")) & (~F.col("even") | (F.col("x") > F.col("y"))) & (F.col("x") != F.col("y")))
    pairs = save(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    ids = ordered.select("g", "xs")
    both = pairs.join(ids.withColumnsRenamed({"g": "a", "xs": "xa"}), "a").join(ids.withColumnsRenamed({"g": "b", "xs": "xb"}), "b")
    c = F.size(F.array_intersect("xa", "xb"))
    return both.select("a", "b", (c / (F.size("xa") + F.size("xb") - c)).alias("similarity")).filter(F.col("similarity") >= threshold)
