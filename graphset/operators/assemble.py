"""Candidate generation: graphs merged at vertices or ring edges, scored, and grown step by step.

Bases and blocks are tables (gid, …), which are brought into one row for each graph.  A candidate is one site of one pair of base
and block, and one row: it is made where its pair lies, so that candidates, which are many times the pairs, are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.operators import merging
from graphset.operators.alike import Alike, alike, once
from graphset.operators.codes import shapes, with_codes
from graphset.operators.rings import rings
from graphset.operators.tables import symmetrize
from graphset.storage import join_hot, save, small


def valence(v: DataFrame, e: DataFrame, caps: DataFrame) -> DataFrame:
    """gid, vid, vlb, ev (sum of bond orders), tv (cap of the label), iv (what is free)."""
    ev = symmetrize(e.select("gid", "src", "dst", "elb")).groupBy("gid", F.col("src").alias("vid")).agg(F.sum(F.col("elb").cast("double")).alias("ev"))
    out = v.join(ev, ["gid", "vid"], "left").join(small(caps.select("vlb", F.col("cap").alias("tv"))), "vlb")
    ev = F.coalesce("ev", F.lit(0.0))
    return out.select("gid", "vid", "vlb", ev.alias("ev"), "tv", (F.col("tv") - ev).alias("iv"))


def node_sites(base: DataFrame, block: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, block, u, w with labels: the vertices (valence tables) of each pair (base, block) that may merge.

    Both must be free, and the bonds of both must fit the larger cap.
    """
    a = base.filter("iv > 0").select(F.col("gid").alias("base"), F.col("vid").alias("u"), F.col("vlb").alias("ul"), F.col("ev").alias("eu"), F.col("tv").alias("tu"))
    b = block.filter("iv > 0").select(F.col("gid").alias("block"), F.col("vid").alias("w"), F.col("vlb").alias("wl"), F.col("ev").alias("ew"), F.col("tv").alias("tw"))
    sites = pairs.select("base", "block").join(a, "base").join(b, "block").filter(F.col("eu") + F.col("ew") <= F.greatest("tu", "tw"))
    return sites.select("base", "block", "u", "w", "ul", "wl")


def packed(v: DataFrame, e: DataFrame, caps: DataFrame) -> DataFrame:
    """gid, vs (vid, vlb, ev, tv), es (src < dst, elb), by (the largest vid, and 1): one row for each graph, by one shuffle of its
    vertices and one of its edges.  Parallel bonds are added up and loops go; a label without a cap has none."""
    v, e = v.select("gid", "vid", "vlb").repartition("gid"), e.select("gid", "src", "dst", F.col("elb").cast("double").alias("w")).repartition("gid")
    order = e.select("gid", F.explode(F.array("src", "dst")).alias("vid"), "w").groupBy("gid", "vid").agg(F.sum("w").alias("ev"))
    rich = v.join(order, ["gid", "vid"], "left").join(small(caps.select("vlb", F.col("cap").alias("tv"))), "vlb", "left")
    vs = rich.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("vid", "vlb", F.coalesce("ev", F.lit(0.0)).alias("ev"), "tv"))).alias("vs"))
    bonds = e.filter("src <> dst").groupBy("gid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    es = bonds.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.col("w").cast("string").alias("elb")))).alias("es"))
    none = F.array().cast(es.schema["es"].dataType)
    by = F.array_max(F.transform("vs", lambda x: x["vid"])) + 1
    return vs.join(es, "gid", "left").select("gid", "vs", F.coalesce("es", none).alias("es"), by.alias("by"))


def _pairs_of(base: DataFrame, block: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair (base, block) with both graphs, packed, in one row: vs, es, by of the base and vs2, es2 of the block."""
    out = pairs.select("base", "block").join(base.withColumnRenamed("gid", "base"), "base")
    return out.join(block.drop("by").withColumnsRenamed({"gid": "block", "vs": "vs2", "es": "es2"}), "block")


def node_merges(base: DataFrame, block: DataFrame, pairs: DataFrame, *bodies: str, valid: bool = False) -> DataFrame:
    """All node merges of the pairs (base, block) of packed graphs, one row (cand, base, block, u, w, keep) each: u and w are the
    vertices that become one (the block's behind the base's), keep says which survives; unequal labels give both survivors, equal
    labels one.  With ``bodies`` 'vs' and 'es' come the vertices and bonds of the candidate, with ``valid`` only candidates that have no
    vertex above its cap.  Nothing is shuffled behind the graphs of a pair."""
    rows = _pairs_of(base, block, pairs)
    return rows.mapInArrow(merging.merges(merging.node_sites, "n", *bodies, valid=valid), merging.schema(rows.schema, *bodies))


def exploded(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, vertices, edges) of candidates that are one row each."""
    vs = rows.select("cand", F.explode("vs").alias("x")).select("cand", "x.vid", "x.vlb")
    es = rows.select("cand", F.explode("es").alias("x")).select("cand", "x.src", "x.dst", "x.elb")
    return rows.select("cand", "base", "block"), vs, es


def merge_nodes(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, pairs: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, vertices, edges) of all node merges of the pairs (base, block): unequal labels give both survivors, equal labels one."""
    return exploded(node_merges(*both_packed(v1, e1, v2, e2, caps), pairs, "vs", "es"))


def both_packed(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases and blocks, packed and written; once, if they are the same tables."""
    base = save(packed(v1, e1, caps))
    return base, base if v2 is v1 and e2 is e1 else save(packed(v2, e2, caps))


def ring_sites(v: DataFrame, e: DataFrame, caps: DataFrame) -> DataFrame:
    """gid, a, b (a < b), la, lb: ring edges, of which loops are none, with both ends free."""
    ring = rings(e).select("gid", "ring")
    on = e.filter("src <> dst").join(ring, "gid").filter(F.array_contains("ring", F.col("src")) & F.array_contains("ring", F.col("dst"))).select("gid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    free = valence(v, e, caps).filter("iv > 0").select("gid", "vid", "vlb")
    return on.join(free.withColumnsRenamed({"vid": "a", "vlb": "la"}), ["gid", "a"]).join(free.withColumnsRenamed({"vid": "b", "vlb": "lb"}), ["gid", "b"])


def edge_merges(base: DataFrame, block: DataFrame, left: DataFrame, right: DataFrame, pairs: DataFrame, *bodies: str, valid: bool = False) -> DataFrame:
    """All ring-edge merges of the pairs (base, block) of packed graphs, as ``node_merges``: every ring edge (gid, a, b, la, lb) of
    the base against every one of the block in both directions; unequal label sets give both survivors."""

    def held(sites, name):
        return sites.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("a", "b", "la", "lb"))).alias(name))

    rows = _pairs_of(base.join(held(left, "xs"), "gid"), block.join(held(right, "ys"), "gid"), pairs)
    return rows.mapInArrow(merging.merges(merging.edge_sites, "e", *bodies, valid=valid), merging.schema(rows.schema, *bodies))


def both_ring_sites(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ring_sites`` of bases and blocks, worked out once for graphs that are alike; once, if they are the same tables."""
    left = save(once(v1, e1, lambda v, e: ring_sites(v, e, caps)))
    return left, left if v2 is v1 and e2 is e1 else save(once(v2, e2, lambda v, e: ring_sites(v, e, caps)))


def merge_edges(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, pairs: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, vertices, edges) of all ring-edge merges of the pairs; unequal label sets give both survivors."""
    return exploded(edge_merges(*both_packed(v1, e1, v2, e2, caps), *both_ring_sites(v1, e1, v2, e2, caps), pairs, "vs", "es"))


def _least(shaped: DataFrame, *by: str) -> DataFrame:
    """by…, code, cand: the least candidate (cand, by…, shape) of each canonical code and values of ``by``."""
    return with_codes(shaped).groupBy(*by, "code").agg(F.min("cand").alias("cand"))


def sanitize(cands: DataFrame, v: DataFrame, e: DataFrame, caps: DataFrame) -> DataFrame:
    """cand, base, code of the valid candidates (no vertex above its cap), one of each canonical code per base, sorted."""
    vv, ee = v.withColumnRenamed("cand", "gid"), e.withColumnRenamed("cand", "gid")
    bad = valence(vv, ee, caps).filter("iv < -1e-9").select(F.col("gid").alias("cand")).distinct()
    shaped = cands.join(bad, "cand", "left_anti").join(shapes(v, e, "cand"), "cand").select("cand", "base", "shape")
    return _least(shaped, "base").orderBy("base", "code")


def _sanitized(valid: DataFrame) -> DataFrame:
    """base, block, code, cand: the least of valid candidates that are one row each, of each canonical code and pair."""
    return _least(valid.select("cand", "base", "block", F.struct("vs", F.array_sort("es").alias("es")).alias("shape")), "base", "block")


def _pairs_alike(base: Alike, block: Alike, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each pair (base, block) with fb and fk, the graphs that stand for its own, and (base, block, n) of the distinct ones of these
    with the number of pairs that are alike; both written."""
    firsts = [some.members.select(F.col("gid").alias(name), F.col("first").alias(f)) for some, name, f in ((base, "base", "fb"), (block, "block", "fk"))]
    to = save(pairs.select("base", "block").join(firsts[0], "base").join(firsts[1], "block"))
    return to, save(to.groupBy(F.col("fb").alias("base"), F.col("fk").alias("block")).agg(F.count("*").alias("n")))


def _renamed(cand: Column) -> Column:
    """The name of a candidate of the graphs that stand for a pair, as that of the pair (base, block)."""
    name = F.split(cand, "/")
    return F.array_join(F.concat(F.array(F.get(name, F.lit(0)), F.col("base").cast("string"), F.col("block").cast("string")), F.slice(name, 4, F.size(name))), "/")


def sanitized_nodes(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, pairs: DataFrame, caps: DataFrame) -> DataFrame:
    """``sanitize`` of ``merge_nodes``, with candidates worked on once for all pairs of which both graphs are alike: cand, base, code,
    sorted."""
    base = alike(v1, e1)
    block = base if v2 is v1 and e2 is e1 else alike(v2, e2)
    to, few = _pairs_alike(base, block, pairs)
    codes = _sanitized(node_merges(*both_packed(base.v, base.e, block.v, block.e, caps), few, "vs", "es", valid=True))
    held = save(codes.groupBy("base", "block").agg(F.collect_list(F.struct("code", "cand")).alias("found")).join(few, ["base", "block"]))
    met = join_hot(to, held.withColumnsRenamed({"base": "fb", "block": "fk"}).hint("merge"), ["fb", "fk"], "n")
    # codes of one pair differ, so only those of bases with several blocks are looked at again
    met = met.join(small(pairs.groupBy("base").count().filter("count > 1").select("base", F.lit(True).alias("several"))), "base", "left")
    met = save(met.select("base", "block", "several", F.explode("found").alias("x")).select("base", "several", "x.code", _renamed(F.col("x.cand")).alias("cand")))
    again = met.filter("several").groupBy("base", "code").agg(F.min("cand").alias("cand"))
    return met.filter("several IS NULL").select("base", "code", "cand").unionByName(again).orderBy("base", "code")


def expand_step(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame, pairs: DataFrame, caps: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step: all candidates of every base and the blocks that ``pairs`` offers it, scored by ``score(vertices, edges) -> (gid, score)``; the best of each base
    stays (ties to the smaller code), as (chosen, vertices, edges) with the base's gid."""
    return _expanded(alike(v1, e1), alike(v2, e2), pairs, caps, score)


def _expanded(base: Alike, block: Alike, pairs: DataFrame, caps: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``expand_step``, with candidates worked on once for all pairs of which both graphs are alike."""
    to, few = _pairs_alike(base, block, pairs)
    parts = [save(packed(some.v, some.e, caps)) for some in (base, block)]
    sites = [save(ring_sites(some.v, some.e, caps)) for some in (base, block)]
    rows = save(node_merges(*parts, few, "vs", "es", valid=True).unionByName(edge_merges(*parts, *sites, few, "vs", "es", valid=True)))
    _, v, e = exploded(rows)
    valid = save(_sanitized(rows))
    scored = valid.join(score(v.withColumnRenamed("cand", "gid"), e.withColumnRenamed("cand", "gid")).withColumnRenamed("gid", "cand"), "cand")
    first = F.row_number().over(Window.partitionBy("base", "block").orderBy(F.desc("score"), "code"))
    best = save(scored.withColumn("k", first).filter("k = 1").drop("k").join(few, ["base", "block"]))
    met = join_hot(to, best.withColumnsRenamed({"base": "fb", "block": "fk", "cand": "of"}).hint("merge"), ["fb", "fk"], "n")
    met = met.select("base", "of", "code", "score", _renamed(F.col("of")).alias("cand"))
    first = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("score"), "code", "cand"))
    best = save(met.withColumn("k", first).filter("k = 1").drop("k"))
    uses = best.groupBy("of").agg(F.count("*").alias("n"))
    bodies = save(rows.select(F.col("cand").alias("of"), "vs", "es").join(uses, "of"))
    grown = save(join_hot(best.select(F.col("base").alias("gid"), "of"), bodies.hint("merge"), ["of"], "n").select("gid", "vs", F.array_sort("es").alias("es")))
    nv = grown.select("gid", F.explode("vs").alias("x")).select("gid", "x.vid", "x.vlb")
    ne = grown.select("gid", F.posexplode("es").alias("eid", "x")).select("gid", "eid", "x.src", "x.dst", "x.elb")
    return best.drop("of"), nv, ne


def rollout(v: DataFrame, e: DataFrame, blocks: tuple[DataFrame, DataFrame], caps: DataFrame, score: Callable, steps: int, seed: int = 0) -> DataFrame:
    """gid, step, score: every start graph grown for up to ``steps`` steps, all at once.

    Blocks are dealt to as many slots as there are blocks, by a hash; in each step a graph is offered the blocks of the slot
    that a hash of seed, step and its id names.  A graph that no longer grows, or whose score falls, ends.
    """
    ids = save(blocks[0].select(F.col("gid").alias("block")).distinct())
    n = max(1, ids.count())
    slots = ids.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(n)))
    offered = alike(*blocks)
    out, last = None, None
    for step in range(steps):
        asked = v.select(F.col("gid").alias("base")).distinct().withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "base"), F.lit(n)))
        best, v, e = _expanded(alike(v, e), offered, save(asked.join(slots, "slot").select("base", "block")), caps, score)
        now = best.select(F.col("base").alias("gid"), F.lit(step).alias("step"), F.col("score").cast("double").alias("score"))
        if last is not None:
            now = now.join(last.select("gid", F.col("score").alias("before")), "gid").filter("score >= before").drop("before")
        now = save(now)
        out = now if out is None else out.unionByName(now)
        if now.isEmpty():
            break
        v, e, last = v.join(now.select("gid"), "gid", "left_semi"), e.join(now.select("gid"), "gid", "left_semi"), now
    return out


def trajectory_summary(states: DataFrame) -> DataFrame:
    """gid, steps, total, final: the sum of the scores and the last one of each walk."""
    return states.groupBy("gid").agg(F.count("*").alias("steps"), F.sum("score").alias("total"), F.max_by("score", "step").alias("final"))


def stop_before(states: DataFrame, threshold: float) -> DataFrame:
    """The record one step before a walk first passes the threshold."""
    first = states.filter(F.col("score") > threshold).groupBy("gid").agg(F.min("step").alias("hit"))
    return states.join(first, "gid").filter(F.col("step") == F.col("hit") - 1).drop("hit")
