"""Queries of pattern mining, matching, rings and junction trees over the order graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphset.operators import matching, mining, rings
from graphset.operators.alike import once
from graphset.operators.mining import MiningConfig
from graphset.operators.tables import with_labels
from graphset.plans import order_graphs as og
from graphset.storage import join_hot, save

G = f"WITH {og.SQL}"
R = f"WITH RECURSIVE {og.SQL}"
QUERIES = {}
SQL: dict[str, str] = {}
#: Graphs that a pattern must lie in.
SUPPORT = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LABELLED = f"""{G}, la AS (SELECT e.gid, e.src, e.dst, e.eid, e.elb, a.vlb AS slb, b.vlb AS dlb FROM ge e
JOIN gv a ON a.gid = e.gid AND a.vid = e.src JOIN gv b ON b.gid = e.gid AND b.vid = e.dst)"""


@query(f"{G} SELECT vlb, count(DISTINCT gid) AS support FROM gv GROUP BY vlb HAVING count(DISTINCT gid) >= {SUPPORT}")
def frequent_vertex_labels(spark, d):
    return mining.frequent_vertex_labels(og.order_vertices(spark, d), SUPPORT)


@query(f"{LABELLED} SELECT slb AS vlb1, elb, dlb AS vlb2, count(DISTINCT gid) AS support, count(*) AS embeddings FROM la WHERE slb <= dlb GROUP BY ALL HAVING count(DISTINCT gid) >= 5")
def frequent_edges(spark, d):
    return mining.frequent_edges(*og.order_graphs(spark, d), 5)


@query(f"""{LABELLED} SELECT a.gid, concat_ws(',', a.src, a.dst, b.dst, c.dst) AS vids FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.dst JOIN la c ON c.gid = a.gid AND c.src = b.dst
WHERE a.slb = 'NO' AND a.elb = '1' AND a.dlb = 'NO' AND b.elb = '1' AND b.dlb = 'NO' AND c.elb = '2' AND c.dlb = 'NO'
AND b.dst <> a.src AND c.dst <> a.src AND c.dst <> a.dst""")
def match_pattern(spark, d):
    found = mining.match_pattern(*og.order_graphs(spark, d), "0,1,NO,1,NO;1,2,NO,1,NO;2,3,NO,2,NO")
    return found.select("gid", F.array_join("vids", ",").alias("vids"))


@query(f"""{LABELLED} SELECT a.gid, concat_ws(',', a.src, a.dst, b.dst, c.dst) AS vids FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.dst JOIN la c ON c.gid = a.gid AND c.src = b.dst JOIN la z ON z.gid = a.gid AND z.src = c.dst AND z.dst = a.src
WHERE a.slb = 'NO' AND a.dlb = 'NO' AND b.dlb = 'NO' AND c.dlb = 'NO' AND a.elb = '1' AND b.elb = '1' AND c.elb = '1' AND z.elb = '1' AND b.dst <> a.src AND c.dst <> a.dst
AND a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst < c.dst""")
def match_once(spark, d):
    """Rings of four, of whose eight symmetric places each comes once."""
    found = matching.match_once(*og.order_graphs(spark, d), "0,1,NO,1,NO;1,2,NO,1,NO;2,3,NO,1,NO;3,0,NO,1,NO")
    return found.select("gid", F.array_join("vids", ",").alias("vids"))


@query(f"""{LABELLED}, parts AS (SELECT a.gid, 3 AS size, list_sort([a.src, a.dst, b.dst]) AS members FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.dst AND b.dst <> a.src WHERE a.slb = 'NO' AND a.elb = '1' AND a.dlb = 'NO' AND b.elb = '2' AND b.dlb = 'RF'
UNION SELECT gid, 2, list_sort([src, dst]) FROM la WHERE slb = 'NO' AND ((elb = '1' AND dlb = 'NO') OR (elb = '2' AND dlb = 'RF'))
UNION SELECT gid, 1, [vid] FROM gv WHERE vlb IN ('NO', 'RF'))
SELECT gid, size, array_to_string(members, ',') AS members FROM parts QUALIFY size = max(size) OVER (PARTITION BY gid)""")
def largest_common(spark, d):
    """The largest parts of NO -1- NO -2- RF in each order."""
    found = once(*og.order_graphs(spark, d), lambda v, e: matching.largest_common(v, e, "0,1,NO,1,NO;1,2,NO,2,RF"))
    return found.select("gid", "size", F.array_join(F.array_sort(F.filter("vids", lambda x: x.isNotNull())), ",").alias("members"))


TWO = f"""{LABELLED}, two AS (SELECT a.gid, a.slb AS c, a.elb AS e1, a.dlb AS l1, b.elb AS e2, b.dlb AS l2 FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.src AND b.eid <> a.eid AND (a.elb, a.dlb) <= (b.elb, b.dlb)),
one AS (SELECT gid, elb, slb, dlb FROM la WHERE slb <= dlb),
pat AS (SELECT 1 AS num_edge, count(DISTINCT gid) AS support, count(*) AS embeddings FROM one GROUP BY elb, slb, dlb
UNION ALL SELECT 2, count(DISTINCT gid), count(*) FROM two GROUP BY c, e1, l1, e2, l2)"""


@query(f"{TWO} SELECT CAST(num_edge AS INT) AS num_edge, support, embeddings, count(*) AS patterns FROM pat WHERE support >= {SUPPORT} GROUP BY ALL")
def mine_frequent(spark, d):
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, max_edges=2))
    return patterns.groupBy("num_edge", "support", "embeddings").agg(F.count("*").alias("patterns"))


@query()
def mine_frequent_three_edges(spark, d):
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT // 2, max_edges=3))
    return mining.describe(patterns)


THREE = f"""{LABELLED}, walks AS (SELECT a.gid, 'path' AS shape, least(concat_ws(',', a.slb, a.elb, a.dlb, b.elb, b.dlb, c.elb, c.dlb), concat_ws(',', c.dlb, c.elb, c.slb, b.elb, b.slb, a.elb, a.slb)) AS k,
    concat_ws(',', a.slb, a.elb, a.dlb, b.elb, b.dlb, c.elb, c.dlb) AS own, concat_ws(',', c.dlb, c.elb, c.slb, b.elb, b.slb, a.elb, a.slb) AS back
  FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.dst AND b.dst <> a.src JOIN la c ON c.gid = a.gid AND c.src = b.dst AND c.dst <> a.dst AND c.dst <> a.src),
stars AS (SELECT a.gid, 'star' AS shape, concat_ws(',', a.slb, a.elb, a.dlb, b.elb, b.dlb, c.elb, c.dlb) AS k FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.src AND b.eid <> a.eid AND (a.elb, a.dlb) <= (b.elb, b.dlb)
  JOIN la c ON c.gid = a.gid AND c.src = a.src AND c.eid <> a.eid AND c.eid <> b.eid AND (b.elb, b.dlb) <= (c.elb, c.dlb)),
tri AS (SELECT a.gid, a.slb AS l0, a.elb AS e0, a.dlb AS l1, b.elb AS e1, b.dlb AS l2, c.elb AS e2 FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.dst AND b.dst <> a.src JOIN la c ON c.gid = a.gid AND c.src = b.dst AND c.dst = a.src),
tris AS (SELECT gid, concat_ws(',', l0, e0, l1, e1, l2, e2) AS own, least(concat_ws(',', l0, e0, l1, e1, l2, e2), concat_ws(',', l1, e1, l2, e2, l0, e0), concat_ws(',', l2, e2, l0, e0, l1, e1),
  concat_ws(',', l0, e2, l2, e1, l1, e0), concat_ws(',', l1, e0, l0, e2, l2, e1), concat_ws(',', l2, e1, l1, e0, l0, e2)) AS k FROM tri),
three AS (SELECT gid, shape, k FROM walks WHERE own = k UNION ALL SELECT gid, shape, k FROM stars UNION ALL SELECT gid, 'ring', k FROM tris WHERE own = k),
p3 AS (SELECT shape, k, count(DISTINCT gid) AS support, count(*) AS embeddings FROM three GROUP BY shape, k)"""


@query(f"{THREE} SELECT shape, support, embeddings, count(*) AS patterns FROM p3 WHERE support >= {SUPPORT // 5} GROUP BY ALL")
def mine_three_edges(spark, d):
    """Patterns of three edges by shape, support and embeddings."""
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT // 5, max_edges=3))
    ends = F.flatten(F.transform(F.split("code", ";"), lambda x: F.slice(F.split(x, ","), 1, 2)))
    often = F.array_max(F.transform(F.array_distinct(ends), lambda v: F.size(F.filter(ends, lambda x: x == v))))
    shape = F.when(F.col("num_vert") == 3, "ring").when(often == 3, "star").otherwise("path")
    return patterns.filter("num_edge = 3").groupBy(shape.alias("shape"), "support", "embeddings").agg(F.count("*").alias("patterns"))


@query()
def mine_frequent_all(spark, d):
    """Growth goes on until no pattern is frequent: at sf0.01 after patterns of four edges."""
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT // 5))
    return mining.describe(patterns)


@query(f"""{LABELLED} SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, count(DISTINCT gid) AS support, count(*) AS embeddings, CAST(2 AS INT) AS num_vert, CAST(1 AS INT) AS num_edge FROM la WHERE slb <= dlb GROUP BY ALL HAVING count(DISTINCT gid) >= {SUPPORT}
UNION ALL SELECT vlb, count(DISTINCT gid), count(*), 1, 0 FROM gv GROUP BY vlb HAVING count(DISTINCT gid) >= {SUPPORT}""")
def mine_size_bounds(spark, d):
    """From one vertex to two."""
    return mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, min_vertices=1, max_vertices=2))[0]


@query(f"""{LABELLED}, one AS (SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, slb, elb, dlb FROM la WHERE slb <= dlb GROUP BY ALL HAVING count(DISTINCT gid) >= {SUPPORT})
SELECT code, CAST(0 AS INT) AS src, CAST(1 AS INT) AS dst, elb, slb, dlb FROM one""")
def code_to_graph(spark, d):
    """Patterns of one edge as graphs again, edges with the labels of their ends."""
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, max_edges=1))
    pv, pe = mining.code_to_graph(patterns)
    ends = [pv.select("code", F.col("vid").alias(end), F.col("vlb").alias(f"{end[0]}lb")) for end in ("src", "dst")]
    return pe.join(ends[0], ["code", "src"]).join(ends[1], ["code", "dst"]).select("code", "src", "dst", "elb", "slb", "dlb")


@query(f"""{LABELLED}, one AS (SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, gid FROM la WHERE slb <= dlb)
SELECT code, gid, count(*) AS n FROM one WHERE code IN (SELECT code FROM one GROUP BY code HAVING count(DISTINCT gid) >= {SUPPORT}) GROUP BY ALL""")
def occurrences(spark, d):
    _, places = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, max_edges=1))
    return mining.occurrences(places)


@query(f"{LABELLED} SELECT DISTINCT gid FROM la WHERE slb = 'NO' AND elb = '2' AND dlb = 'NO'")
def where(spark, d):
    _, places = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(1, max_edges=1))
    return mining.where(mining.occurrences(places), "0,1,NO,2,NO")


@query(f"""{LABELLED}, one AS (SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, gid FROM la WHERE slb <= dlb), p AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS n FROM (SELECT code FROM one GROUP BY code HAVING count(DISTINCT gid) >= {SUPPORT})),
c AS (SELECT gid, p.n, count(*) AS k FROM one JOIN p USING (code) GROUP BY ALL) SELECT gid, string_agg(concat(n, ':', k), ',' ORDER BY n) AS entries FROM c GROUP BY gid""")
def pattern_vectors(spark, d):
    patterns, places = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, max_edges=1))
    rows = mining.pattern_vectors(mining.occurrences(places), patterns)
    return rows.select("gid", F.array_join(F.zip_with("at", "n", lambda a, n: F.concat_ws(":", a, n)), ",").alias("entries"))


@query(f"""{LABELLED} SELECT gid, CAST(count(*) FILTER (elb = '1') AS BIGINT) AS p0, CAST(count(*) FILTER (elb = '2') AS BIGINT) AS p1 FROM la WHERE slb = 'NO' AND dlb = 'NO' GROUP BY gid""")
def pattern_matrix(spark, d):
    _, places = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(1, max_edges=1))
    return mining.pattern_matrix(mining.occurrences(places), ["0,1,NO,1,NO", "0,1,NO,2,NO"])


@query(f"""{LABELLED} SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, count(DISTINCT gid) AS support FROM la WHERE slb <= dlb GROUP BY ALL ORDER BY support DESC, code LIMIT 5""")
def top_patterns(spark, d):
    patterns, _ = mining.mine_frequent(*og.order_graphs(spark, d), MiningConfig(SUPPORT, max_edges=1))
    return mining.top_patterns(patterns, 5).select("code", "support")


def _event_graphs(spark, d):
    arcs = og.event_arcs(spark, d).filter("src <> dst").select("gid", "src", "dst").distinct()
    names = arcs.select("gid", F.col("src").alias("vlb")).unionByName(arcs.select("gid", F.col("dst").alias("vlb"))).distinct()
    v = names.select("gid", F.abs(F.hash("vlb")).alias("vid"), "vlb")
    e = arcs.select("gid", F.xxhash64("src", "dst").alias("eid"), F.abs(F.hash("src")).alias("src"), F.abs(F.hash("dst")).alias("dst"), F.lit("1").alias("elb"))
    return v, e


@query("""WITH a AS (SELECT user_id AS gid, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
p AS (SELECT DISTINCT gid, src, dst FROM a WHERE dst IS NOT NULL AND src <> dst),
two AS (SELECT x.gid, x.src AS a, x.dst AS b, y.src AS c, y.dst AS d FROM p x JOIN p y ON y.gid = x.gid AND (x.src, x.dst) < (y.src, y.dst) AND (x.src IN (y.src, y.dst) OR x.dst IN (y.src, y.dst))),
n AS (SELECT 1 AS num_edge, count(*) AS support FROM p GROUP BY src, dst UNION ALL SELECT 2, count(*) FROM two GROUP BY a, b, c, d)
SELECT CAST(num_edge AS INT) AS num_edge, support, count(*) AS patterns FROM n WHERE support >= 2 GROUP BY ALL""")
def mine_directed_two_arcs(spark, d):
    patterns, _ = mining.mine_frequent(*_event_graphs(spark, d), MiningConfig(2, max_edges=2, directed=True))
    return patterns.groupBy("num_edge", "support").agg(F.count("*").alias("patterns"))


@query(f"""WITH a AS (SELECT user_id AS gid, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
p AS (SELECT concat_ws(',', '0', '1', src, '1', dst) AS code, gid FROM a WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)
SELECT code, count(*) AS support FROM p GROUP BY code HAVING count(*) >= 2""")
def mine_directed(spark, d):
    v, e = _event_graphs(spark, d)
    patterns, _ = mining.mine_frequent(v, e, MiningConfig(2, max_edges=1, directed=True))
    return patterns.select("code", "support")


@query(f"""{R}, part AS (SELECT ge.gid, src, dst FROM ge JOIN gv a ON a.gid = ge.gid AND a.vid = src JOIN gv b ON b.gid = ge.gid AND b.vid = dst WHERE a.vlb = b.vlb), reach AS (SELECT gid, vid, vid AS r FROM gv UNION SELECT p.gid, reach.vid, p.dst FROM reach JOIN part p ON p.gid = reach.gid AND p.src = reach.r)
SELECT gid, vid, min(r) AS comp FROM reach GROUP BY gid, vid""")
def components(spark, d):
    return once(*og.written_graphs(spark, d), lambda v, e: rings.components(v, with_labels(v, e).filter("slb = dlb")), written=True)


@query(f"""{R}, part AS (SELECT ge.gid, src, dst FROM ge JOIN gv a ON a.gid = ge.gid AND a.vid = src JOIN gv b ON b.gid = ge.gid AND b.vid = dst WHERE a.vlb = b.vlb), reach AS (SELECT gid, vid, vid AS r FROM gv UNION SELECT p.gid, reach.vid, p.dst FROM reach JOIN part p ON p.gid = reach.gid AND p.src = reach.r)
SELECT gid, vid FROM reach GROUP BY gid, vid HAVING count(*) > 2""")
def filter_components(spark, d):
    """Vertices that lie in components of equal labels of more than two."""
    return once(*og.written_graphs(spark, d), lambda v, e: rings.filter_components(v, with_labels(v, e).filter("slb = dlb"), 2).select("gid", "vid"), written=True)


PATHS = f"""{R}, walk AS (SELECT gid, eid, dst AS goal, src AS last, [src] AS path, 1 AS n FROM ge0
UNION ALL SELECT w.gid, w.eid, w.goal, e.dst, list_append(w.path, e.dst), w.n + 1 FROM walk w JOIN ge e ON e.gid = w.gid AND e.src = w.last AND e.eid <> w.eid WHERE NOT list_contains(w.path, e.dst) AND w.last <> w.goal),
cyc AS (SELECT gid, eid, list_sort(path) AS ring, n, min(n) OVER (PARTITION BY gid, eid) AS least FROM walk WHERE last = goal),
er AS (SELECT DISTINCT gid, eid, ring FROM cyc WHERE n = least)"""


@query(f"{PATHS} SELECT DISTINCT gid, array_to_string(ring, ',') AS ring FROM er")
def rings_of(spark, d):
    return rings.rings(og.order_edges(spark, d)).withColumn("ring", F.array_join("ring", ","))


@query(f"{PATHS} SELECT gid, src, dst, elb FROM ge0 WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.gid = ge0.gid AND er.eid = ge0.eid)")
def bridge_edges(spark, d):
    return rings.bridge_edges(og.order_edges(spark, d)).drop("eid")


@query(f"{PATHS} SELECT gid, src, dst, elb FROM ge0 WHERE EXISTS (SELECT 1 FROM er WHERE er.gid = ge0.gid AND er.eid = ge0.eid)")
def ring_edges(spark, d):
    return rings.ring_edges(og.order_edges(spark, d)).drop("eid")


@query(f"""{G}, sizes AS (SELECT gn.gid, n, count(*) FILTER (elb = '1' AND dst = src + 3) AS chords, count(*) AS edges FROM gn JOIN ge0 ON ge0.gid = gn.gid GROUP BY gn.gid, n)
SELECT gid, CAST(edges - n + 1 AS BIGINT) AS rings, CAST(4 * chords + n - 2 * chords AS BIGINT) AS total FROM sizes WHERE n >= 3""")
def cycle_basis(spark, d):
    """Number and total length of the rings of a smallest basis: four to a chord, and the ring that goes along all chords."""
    basis = rings.cycle_basis(og.order_edges(spark, d))
    return basis.groupBy("gid").agg(F.count("*").alias("rings"), F.sum(F.size("eids")).alias("total"))


#: Merged rings, cliques (cl), their graph (cg) and its heaviest spanning forest (mst): an edge is in it if no path of edges
#: that rank before it joins its ends.
CLIQUES = f"""{PATHS}, rg AS (SELECT DISTINCT gid, ring FROM er), rn AS (SELECT gid, ring, row_number() OVER (PARTITION BY gid ORDER BY ring) AS rid FROM rg),
sh AS (SELECT a.gid, a.rid AS r1, b.rid AS r2 FROM rn a JOIN rn b ON b.gid = a.gid AND b.rid <> a.rid AND len(list_intersect(a.ring, b.ring)) > 2),
rr AS (SELECT gid, rid, rid AS r FROM rn UNION SELECT rr.gid, rr.rid, sh.r2 FROM rr JOIN sh ON sh.gid = rr.gid AND sh.r1 = rr.r),
rc AS (SELECT gid, rid, min(r) AS comp FROM rr GROUP BY ALL),
mr AS (SELECT rn.gid, comp, list_sort(list_distinct(flatten(list(ring)))) AS members FROM rn JOIN rc ON rc.gid = rn.gid AND rc.rid = rn.rid GROUP BY rn.gid, comp),
basic AS (SELECT gid, 'bond' AS kind, [src, dst] AS members FROM ge0 WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.gid = ge0.gid AND er.eid = ge0.eid)
  UNION ALL SELECT gid, 'ring', members FROM mr UNION ALL SELECT gid, 'atom', [vid] FROM gv WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.gid = gv.gid AND ge.src = gv.vid)),
bm AS (SELECT gid, kind, len(members) AS size, unnest(members) AS vid FROM basic),
joint AS (SELECT gid, 'joint' AS kind, [vid] AS members FROM bm GROUP BY gid, vid HAVING count(*) >= 2 AND (count(*) FILTER (kind = 'bond') > 2
  OR (count(*) FILTER (kind = 'bond') = 2 AND count(*) > 2) OR count(*) FILTER (kind = 'ring' AND size > 4) > 2)),
cl AS (SELECT gid, kind, members, CAST(row_number() OVER (PARTITION BY gid ORDER BY kind, members) - 1 AS INT) AS cid FROM (SELECT * FROM basic UNION ALL SELECT * FROM joint)),
cm AS (SELECT gid, cid, kind, unnest(members) AS vid FROM cl),
vb AS (SELECT gid, vid, count(*) FILTER (kind = 'bond') AS bonds, count(*) FILTER (kind = 'joint') AS joints FROM cm GROUP BY gid, vid),
cg AS (SELECT a.gid, a.cid AS c1, b.cid AS c2, CAST(coalesce(max(CASE WHEN a.kind = 'joint' OR b.kind = 'joint' THEN CASE WHEN bonds >= 2 THEN 1 ELSE 99 END END), count(*)) AS INT) AS w
  FROM cm a JOIN cm b ON b.gid = a.gid AND b.vid = a.vid AND a.cid < b.cid JOIN vb ON vb.gid = a.gid AND vb.vid = a.vid WHERE a.kind = 'joint' OR b.kind = 'joint' OR joints = 0 GROUP BY a.gid, a.cid, b.cid),
ek AS (SELECT gid, c1, c2, w, row_number() OVER (PARTITION BY gid ORDER BY w DESC, c1, c2) AS k FROM cg),
nr AS (SELECT gid, k, c1 AS x, c2 AS y FROM ek UNION ALL SELECT gid, k, c2, c1 FROM ek),
rch AS (SELECT gid, k, c1 AS node FROM ek UNION SELECT r.gid, r.k, n.y FROM rch r JOIN nr n ON n.gid = r.gid AND n.x = r.node AND n.k < r.k),
mst AS (SELECT gid, c1, c2, w FROM ek WHERE NOT EXISTS (SELECT 1 FROM rch WHERE rch.gid = ek.gid AND rch.k = ek.k AND rch.node = ek.c2)),
nb AS (SELECT gid, c1 AS cid, c2 AS o FROM mst UNION ALL SELECT gid, c2, c1 FROM mst)"""


@query(f"{CLIQUES} SELECT gid, cid, kind, array_to_string(members, ',') AS members FROM cl")
def cliques(spark, d):
    return once(*og.written_graphs(spark, d), rings.cliques, written=True).withColumn("members", F.array_join("members", ","))


@query(f"{CLIQUES} SELECT gid, c1, c2, w FROM cg")
def clique_graph(spark, d):
    return once(*og.written_graphs(spark, d), lambda v, e: rings.clique_graph(save(rings.cliques(v, e))), written=True)


@query(f"{CLIQUES} SELECT gid, c1, c2, w FROM mst")
def max_spanning_tree(spark, d):
    return once(*og.written_graphs(spark, d), lambda v, e: rings.max_spanning_tree(save(rings.clique_graph(save(rings.cliques(v, e))))), written=True)


@query(f"""{CLIQUES}, rt AS (SELECT gid, min(CASE WHEN list_contains(members, 0) THEN cid ELSE 1000000 + cid END) % 1000000 AS root FROM cl GROUP BY gid),
ns AS (SELECT gid, cid, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours, count(*) AS n FROM nb GROUP BY gid, cid)
SELECT cl.gid, cl.cid, kind, array_to_string(members, ',') AS members, coalesce(neighbours, '') AS neighbours, coalesce(n, 0) <= 1 AS is_leaf, cl.cid = root AS is_root FROM cl JOIN rt ON rt.gid = cl.gid LEFT JOIN ns ON ns.gid = cl.gid AND ns.cid = cl.cid""")
def tree_nodes(spark, d):
    def nodes(v, e):
        cl = save(rings.cliques(v, e))
        return rings.tree_nodes(cl, rings.max_spanning_tree(save(rings.clique_graph(cl))))

    return once(*og.written_graphs(spark, d), nodes, written=True).withColumns({c: F.array_join(c, ",") for c in ("members", "neighbours")})


@query(f"""{CLIQUES}, near AS (SELECT gid, cid, o FROM nb UNION ALL SELECT gid, cid, cid FROM cl)
SELECT near.gid, near.cid, cm.vid, array_to_string(list_sort(list(DISTINCT near.o)), ',') AS owners FROM near JOIN cm ON cm.gid = near.gid AND cm.cid = near.o GROUP BY near.gid, near.cid, cm.vid""")
def clique_context(spark, d):
    def context(v, e):
        cl = save(rings.cliques(v, e))
        return rings.clique_context(cl, rings.max_spanning_tree(save(rings.clique_graph(cl))))

    return once(*og.written_graphs(spark, d), context, written=True).withColumn("owners", F.array_join("owners", ","))


#: What a clique induces, as text that is the same for the same shape (kl): the label of a vertex, the ends of a bond in order,
#: and of a ring the least of its labels read from each vertex in both directions; its members stand in ring order by id here.
CLIQUE_LABELS = f"""{CLIQUES}, places AS (SELECT gid, cid, kind, len(members) AS k, members, unnest(range(len(members))) AS i FROM cl),
rim AS (SELECT p.gid, p.cid, p.kind, p.k, p.i, v.vlb, e.elb FROM places p JOIN gv v ON v.gid = p.gid AND v.vid = p.members[p.i + 1] LEFT JOIN ge e ON e.gid = p.gid AND e.src = p.members[p.i + 1] AND e.dst = p.members[(p.i + 1) % p.k + 1]),
lists AS (SELECT gid, cid, kind, any_value(k) AS k, list(vlb ORDER BY i) AS v, list(elb ORDER BY i) AS e FROM rim GROUP BY gid, cid, kind),
turns AS (SELECT gid, cid, kind, k, v, e, unnest(range(k)) AS r FROM lists),
kl AS (SELECT gid, cid, CASE WHEN any_value(k) = 1 THEN any_value(v[1]) WHEN any_value(k) = 2 THEN least(any_value(v[1]), any_value(v[2])) || any_value(e[1]) || greatest(any_value(v[1]), any_value(v[2]))
  ELSE min(least(array_to_string(list_transform(range(k), lambda j: v[(r + j) % k + 1] || e[(r + j) % k + 1]), ' '), array_to_string(list_transform(range(k), lambda j: v[(r - j + k) % k + 1] || e[(r - j - 1 + k) % k + 1]), ' '))) END AS label FROM turns GROUP BY gid, cid)"""


@query(f"{CLIQUE_LABELS} SELECT gid, cid, struct_extract(first, 'gid') AS first_gid, struct_extract(first, 'cid') AS first_cid FROM (SELECT gid, cid, min({{'gid': gid, 'cid': cid}}) OVER (PARTITION BY label) AS first FROM kl)")
def clique_labels(spark, d):
    """Each clique with the first one of its label."""

    def firsts(v, e):
        # the graph of the smallest id stands for all that are alike, so the first clique is among these
        labels = save(rings.clique_labels(v, e, save(rings.cliques(v, e))).withColumn("key", F.md5("label")))
        first = save(labels.groupBy("key").agg(F.min(F.struct("gid", "cid")).alias("first"), F.count("*").alias("n")))
        named = join_hot(labels.select("gid", "cid", "key"), first.hint("merge"), ["key"], "n")
        return named.select("gid", "cid", F.col("first.gid").alias("first_gid"), F.col("first.cid").alias("first_cid"))

    return once(*og.written_graphs(spark, d), firsts, written=True)


@query(f"""{CLIQUE_LABELS}, jt AS (SELECT gid, c1 AS src, c2 AS dst FROM mst UNION ALL SELECT gid, c2, c1 FROM mst),
la AS (SELECT jt.gid, src, dst, a.label AS slb, b.label AS dlb FROM jt JOIN kl a ON a.gid = jt.gid AND a.cid = src JOIN kl b ON b.gid = jt.gid AND b.cid = dst),
one AS (SELECT count(DISTINCT gid) AS support, count(*) AS embeddings FROM la WHERE slb <= dlb GROUP BY slb, dlb),
two AS (SELECT count(DISTINCT a.gid) AS support, count(*) AS embeddings FROM la a JOIN la b ON b.gid = a.gid AND b.src = a.src AND b.dst <> a.dst AND a.dlb <= b.dlb GROUP BY a.slb, a.dlb, b.dlb)
SELECT num_edge, support, embeddings, count(*) AS patterns FROM (SELECT CAST(1 AS INT) AS num_edge, * FROM one UNION ALL SELECT CAST(2 AS INT), * FROM two) WHERE support >= 2 GROUP BY ALL""")
def mine_junction_tree_counts(spark, d):
    """Patterns of one and two edges in the junction trees, by support and embeddings."""
    jv, je, _ = rings.junction_tree_graphs(*(save(t) for t in og.order_graphs(spark, d)))
    patterns, _ = mining.mine_frequent(save(jv), save(je), MiningConfig(2, max_edges=2))
    return patterns.groupBy("num_edge", "support", "embeddings").agg(F.count("*").alias("patterns"))


@query()
def mine_junction_trees(spark, d):
    v, e = og.order_graphs(spark, d)
    jv, je, _ = rings.junction_tree_graphs(v, e)
    patterns, _ = mining.mine_frequent(save(jv), save(je), MiningConfig(3, max_edges=2))
    return mining.describe(patterns)


@query()
def recover_patterns(spark, d):
    """Mined patterns of junction trees, turned back into the vertices that they stand for."""
    v, e = og.order_graphs(spark, d)
    v, e = save(v), save(e)
    jv, je, cl = rings.junction_tree_graphs(v, e)
    _, places = mining.mine_frequent(save(jv), save(je), MiningConfig(3, max_edges=2))
    return rings.recover_patterns(places, cl, v, e)
