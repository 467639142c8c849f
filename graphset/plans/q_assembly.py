"""Queries of candidate generation: orders merged with the same customer's next order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphset.operators import assemble
from graphset.plans import order_graphs as og
from graphset.plans.order_graphs import table
from graphset.plans.q_mining import PATHS
from graphset.storage import save

G = f"WITH {og.SQL}"
QUERIES = {}
SQL: dict[str, str] = {}
#: The caps of the labels by their first letter.  Each order is a base, and the same customer's next order its block.
CAPS = "caps(k, tv) AS (VALUES ('R', 4), ('N', 3), ('A', 2)), pairs AS (SELECT * FROM (SELECT o_orderkey AS base, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS block FROM orders) WHERE block IS NOT NULL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def caps(spark, d):
    """vlb, cap for all labels of the order graphs."""
    labels = og.order_vertices(spark, d).select("vlb").distinct()
    first = F.substring("vlb", 1, 1)
    return labels.select("vlb", F.when(first == "R", 4).when(first == "N", 3).otherwise(2).alias("cap"))


def pairs(spark, d):
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("base"), nxt.alias("block")).filter("block IS NOT NULL")


def parts(spark, d):
    v, e = og.written_graphs(spark, d)
    return v, e, v, e, save(pairs(spark, d))


VALENCE = f"""{G}, {CAPS}, val AS (SELECT v.gid, v.vid, v.vlb, coalesce(sum(CAST(e.elb AS DOUBLE)), 0) AS ev, c.tv FROM gv v LEFT JOIN ge e ON e.gid = v.gid AND e.src = v.vid JOIN caps c ON c.k = v.vlb[1] GROUP BY ALL)"""
SITES = f"""{VALENCE}, sites AS (SELECT a.gid AS base, b.gid AS block, a.vid AS u, b.vid AS w, a.vlb AS ul, b.vlb AS wl FROM pairs p JOIN val a ON a.gid = p.base JOIN val b ON b.gid = p.block
AND a.tv - a.ev > 0 AND b.tv - b.ev > 0 AND a.ev + b.ev <= greatest(a.tv, b.tv))"""


@query(f"{VALENCE} SELECT gid, vid, vlb, ev, tv, tv - ev AS iv FROM val")
def valence(spark, d):
    return assemble.valence(*og.order_graphs(spark, d), caps(spark, d))


@query(f"{SITES} SELECT base, block, u, w FROM sites")
def node_sites(spark, d):
    v, e = og.order_graphs(spark, d)
    free = save(assemble.valence(v, e, caps(spark, d)))
    return assemble.node_sites(free, free, pairs(spark, d)).select("base", "block", "u", "w")


@query(f"{SITES} SELECT base, block, CAST(sum(CASE WHEN ul = wl THEN 1 ELSE 2 END) AS BIGINT) AS candidates FROM sites GROUP BY ALL")
def merge_nodes(spark, d):
    *graphs, which = parts(spark, d)
    cands = assemble.node_merges(*assemble.both_packed(*graphs, caps(spark, d)), which)
    return cands.groupBy("base", "block").agg(F.count("*").alias("candidates"))


@query(f"""{SITES}, k AS (SELECT s.*, unnest(CASE WHEN ul = wl THEN ['u'] ELSE ['u', 'w'] END) AS keep FROM sites s)
SELECT concat_ws('/', 'n', base, block, u, w, keep) AS cand, CAST(x.n + y.n - 1 AS BIGINT) AS n_vertices FROM k JOIN gn x ON x.gid = base JOIN gn y ON y.gid = block""")
def merged_sizes(spark, d):
    *graphs, which = parts(spark, d)
    merges = assemble.node_merges(*assemble.both_packed(*graphs, caps(spark, d)), which, "vs")
    return merges.select("cand", F.size("vs").cast("long").alias("n_vertices"))


@query(f"""{SITES}, k AS (SELECT s.*, unnest(CASE WHEN ul = wl THEN ['u'] ELSE ['u', 'w'] END) AS keep FROM sites s), tw AS (SELECT gid, count(*) AS m, sum(CAST(elb AS DOUBLE)) AS w FROM ge0 GROUP BY gid)
SELECT concat_ws('/', 'n', base, block, u, k.w, keep) AS cand, CAST(coalesce(x.m, 0) + coalesce(y.m, 0) AS BIGINT) AS bonds, coalesce(x.w, 0) + coalesce(y.w, 0) AS total, a.ev + b.ev AS merged
FROM k LEFT JOIN tw x ON x.gid = base LEFT JOIN tw y ON y.gid = block JOIN val a ON a.gid = base AND a.vid = u JOIN val b ON b.gid = block AND b.vid = k.w WHERE coalesce(x.m, 0) + coalesce(y.m, 0) > 0""")
def merged_bonds(spark, d):
    """Bonds of each node merge: how many, their sum, and the sum at the vertex that both became."""
    *graphs, which = parts(spark, d)
    return _bond_sums(assemble.node_merges(*assemble.both_packed(*graphs, caps(spark, d)), which, "es"))


def _bond_sums(merges):
    """cand, bonds, total, merged of each candidate with a bond: their number, their sum, and the sum at the vertices that two
    vertices became."""
    kept = F.when(F.col("keep") == "u", F.col("u")).otherwise(F.col("w"))

    def summed(es, weight):
        return F.aggregate(es, F.lit(0.0), lambda s, x: s + F.coalesce(weight(x), F.lit(0.0)))

    rows = merges.filter(F.size("es") > 0).select("cand", "es", kept.alias("kept"))

    def at_kept(x):
        return x["elb"].cast("double") * (F.array_contains(F.col("kept"), x["src"]).cast("int") + F.array_contains(F.col("kept"), x["dst"]).cast("int"))

    return rows.select("cand", F.size("es").cast("long").alias("bonds"), summed("es", lambda x: x["elb"].cast("double")).alias("total"), summed("es", at_kept).alias("merged"))


RING_SITES = f"""{PATHS}, {CAPS}, rg AS (SELECT DISTINCT gid, ring FROM er), val AS (SELECT v.gid, v.vid, v.vlb, coalesce(sum(CAST(e.elb AS DOUBLE)), 0) AS ev, c.tv FROM gv v LEFT JOIN ge e ON e.gid = v.gid AND e.src = v.vid JOIN caps c ON c.k = v.vlb[1] GROUP BY ALL),
rs AS (SELECT DISTINCT e.gid, least(src, dst) AS a, greatest(src, dst) AS b FROM ge0 e JOIN rg ON rg.gid = e.gid AND list_contains(ring, src) AND list_contains(ring, dst)),
rl AS (SELECT rs.gid, a, b, x.vlb AS la, y.vlb AS lb FROM rs JOIN val x ON x.gid = rs.gid AND x.vid = a AND x.tv > x.ev JOIN val y ON y.gid = rs.gid AND y.vid = b AND y.tv > y.ev)"""


@query(f"{RING_SITES} SELECT gid, a, b, la, lb FROM rl")
def ring_sites(spark, d):
    return assemble.ring_sites(*og.order_graphs(spark, d), caps(spark, d))


@query(f"{RING_SITES} SELECT base, block, CAST(2 * sum(CASE WHEN list_sort([x.la, x.lb]) = list_sort([y.la, y.lb]) THEN 1 ELSE 2 END) AS BIGINT) AS candidates FROM pairs JOIN rl x ON x.gid = base JOIN rl y ON y.gid = block GROUP BY base, block")
def merge_edges(spark, d):
    *graphs, which = parts(spark, d)
    c = caps(spark, d)
    cands = assemble.edge_merges(*assemble.both_packed(*graphs, c), *assemble.both_ring_sites(*graphs, c), which)
    return cands.groupBy("base", "block").agg(F.count("*").alias("candidates"))


@query(f"""{RING_SITES}, way AS (SELECT gid, a AS c, b AS d, la AS lc, lb AS ld FROM rl UNION ALL SELECT gid, b, a, lb, la FROM rl), tw AS (SELECT gid, count(*) AS m, sum(CAST(elb AS DOUBLE)) AS w FROM ge0 GROUP BY gid),
k AS (SELECT p.base, p.block, x.a, x.b, y.c, y.d, unnest(CASE WHEN list_sort([x.la, x.lb]) = list_sort([y.lc, y.ld]) THEN ['u'] ELSE ['u', 'w'] END) AS keep FROM pairs p JOIN rl x ON x.gid = base JOIN way y ON y.gid = block),
s AS (SELECT k.*, CAST(f.elb AS DOUBLE) AS wf, CAST(g.elb AS DOUBLE) AS wg FROM k JOIN ge f ON f.gid = base AND f.src = a AND f.dst = b JOIN ge g ON g.gid = block AND g.src = c AND g.dst = d)
SELECT concat_ws('/', 'e', base, block, a, b, c, d, keep) AS cand, CAST(x.m + y.m - 1 AS BIGINT) AS bonds, x.w + y.w - CASE keep WHEN 'u' THEN wg ELSE wf END AS total,
  va.ev + vb.ev + vc.ev + vd.ev - 2 * CASE keep WHEN 'u' THEN wg ELSE wf END AS merged
FROM s JOIN tw x ON x.gid = base JOIN tw y ON y.gid = block JOIN val va ON va.gid = base AND va.vid = a JOIN val vb ON vb.gid = base AND vb.vid = b JOIN val vc ON vc.gid = block AND vc.vid = c JOIN val vd ON vd.gid = block AND vd.vid = d""")
def merged_edge_bonds(spark, d):
    """Bonds of each ring-edge merge: the survivor's shared bond stays, the other one goes, all else adds up."""
    *graphs, which = parts(spark, d)
    c = caps(spark, d)
    return _bond_sums(assemble.edge_merges(*assemble.both_packed(*graphs, c), *assemble.both_ring_sites(*graphs, c), which, "es"))


@query()
def sanitize(spark, d):
    return assemble.sanitized_nodes(*parts(spark, d), caps(spark, d))


def size_of(v, e):
    return v.groupBy("gid").agg((F.count("*") / 100).alias("score"))


@query()
def rollout(spark, d):
    """Every order grown for two steps with the orders of one or two lines as blocks."""
    v, e = og.written_graphs(spark, d)
    blocks = save(v.groupBy("gid").agg(F.count("*").alias("n")).filter("n <= 2").select("gid"))
    return assemble.rollout(v, e, (v.join(blocks, "gid", "left_semi"), e.join(blocks, "gid", "left_semi")), caps(spark, d), size_of, steps=2)
