"""Queries of scores and graph indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphset.functions import scores
from graphset.operators import fingerprint, indices
from graphset.operators.alike import alike, once
from graphset.plans import order_graphs as og
from graphset.plans.order_graphs import table
from graphset.plans.q_vectors import IDS
from graphset.storage import save

G = f"WITH {og.SQL}"
R = f"WITH RECURSIVE {og.SQL}"
QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FP = f"{IDS}, fp AS (SELECT gid, id AS fid, count(*) AS n FROM ids GROUP BY ALL), fs AS (SELECT fid, log10(sum(n)) AS score FROM fp GROUP BY fid HAVING sum(n) >= 10)"


def _fragments(some):
    """(scores, fragments) of one graph of each class; a fragment counts for all graphs that its graph stands for."""
    fp = save(fingerprint.wl_features(some.v, some.e, 1).withColumnRenamed("id", "fid"))
    known = fp.join(some.sizes, "gid").groupBy("fid").agg(F.sum(F.col("n") * F.col("weight")).alias("k")).filter("k >= 10").select("fid", F.log10(F.col("k").cast("double")).alias("score"))
    return indices.fragment_score(fp, known), fp


@query(f"{FP} SELECT gid, round(sum(n * coalesce(score, -4)) / sum(n), 6) AS score FROM fp LEFT JOIN fs USING (fid) GROUP BY gid")
def fragment_score(spark, d):
    some = alike(*og.order_graphs(spark, d))
    return some.spread(save(_fragments(some)[0].withColumn("score", F.round("score", 6))))


@query(f"""{FP}, f AS (SELECT gid, sum(n * coalesce(score, -4)) / sum(n) AS score, count(*) AS m FROM fp LEFT JOIN fs USING (fid) GROUP BY gid),
raw AS (SELECT gid, n, 11.0 - (score - (pow(CAST(n AS DOUBLE), 1.005) - n) - log10(n % 3 + 1) + CASE WHEN n > m THEN 0.5 * ln(n / m) ELSE 0 END + 5.0) / 6.5 * 9.0 AS x FROM f JOIN gn USING (gid))
SELECT gid, round(greatest(1.0, least(10.0, CASE WHEN x > 8 THEN 8 + ln(x - 8) ELSE x END)), 6) AS sa FROM raw""")
def sa_score(spark, d):
    some = alike(*og.order_graphs(spark, d))
    scored, fp = _fragments(some)
    n = some.v.groupBy("gid").agg(F.count("*").alias("n"))
    m = fp.groupBy("gid").agg(F.count("*").alias("m"))
    all_of = scored.join(n, "gid").join(m, "gid")
    zero = F.lit(0)
    raw = F.col("score") + scores.complexity_penalty(F.col("n"), F.col("n") % 3, zero, zero, zero) + scores.density_bonus(F.col("n"), F.col("m"))
    return some.spread(save(all_of.select("gid", F.round(scores.sa_score(raw), 6).alias("sa"))))


@query("""SELECT event_id, round((value - 2.4570953396190123) / 1.434324401111988 + (-3.0 - -3.0525811293166134) / 0.8335207024513095 + (-greatest(event_id % 12 - 6, 0) - -0.0485696876403053) / 0.2860212110245455, 6) AS score FROM events""")
def penalized_score(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(scores.penalized_score(F.col("value"), F.lit(3.0), F.col("event_id") % 12), 6).alias("score"))


@query("SELECT event_id, round(greatest(0.0, value / 100 - 0.1 * (event_id % 10)), 6) AS score FROM events")
def qed_sa(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.qed_sa(F.col("value") / 100, F.col("event_id") % 10), 6).alias("score"))


@query(f"{G} SELECT gid, round(n / 100, 6) AS score FROM gn")
def size_score(spark, d):
    n = og.order_vertices(spark, d).groupBy("gid").agg(F.count("*").alias("n"))
    return n.select("gid", F.round(scores.size_score(F.col("n")), 6).alias("score"))


def _numbered(spark, d):
    v, e = og.order_graphs(spark, d)
    return v.withColumn("z", F.ascii("vlb") % 10 + F.col("vid")), e


Z = "z AS (SELECT gid, vid, ascii(vlb) % 10 + vid AS z FROM gv), dg AS (SELECT gid, src AS vid, count(*) AS degree FROM ge GROUP BY ALL)"


@query(f"""{G}, {Z} SELECT e.gid, e.src, e.dst, round(sqrt((a.degree + b.degree - 2) / (a.degree * b.degree)) + CAST(elb AS DOUBLE) + (x.z + y.z) / 6, 5) AS index FROM ge0 e
JOIN dg a ON a.gid = e.gid AND a.vid = e.src JOIN dg b ON b.gid = e.gid AND b.vid = e.dst JOIN z x ON x.gid = e.gid AND x.vid = e.src JOIN z y ON y.gid = e.gid AND y.vid = e.dst""")
def abc_index(spark, d):
    v, e = _numbered(spark, d)
    return indices.edge_score(v, e, "abc").join(e, ["gid", "eid"]).select("gid", "src", "dst", "index")


def _paths(length: str) -> str:
    return f"""{R}, walk AS (SELECT gid, src AS a, dst AS b, [src, dst] AS seen, CAST({length} AS DOUBLE) AS d FROM ge
UNION ALL SELECT w.gid, w.a, e.dst, list_append(w.seen, e.dst), w.d + {length} FROM walk w JOIN ge e ON e.gid = w.gid AND e.src = w.b WHERE NOT list_contains(w.seen, e.dst)),
sp AS (SELECT gid, a, b, min(d) AS d FROM walk GROUP BY ALL)"""


@query(f"{_paths('1.0')} SELECT gid, a, b, round(d, 6) AS d FROM sp")
def shortest_paths(spark, d):
    return indices.shortest_paths(*og.order_graphs(spark, d)).withColumn("d", F.round("d", 6))


@query(f"""{_paths('1.0 / CAST(elb AS DOUBLE)')}, s AS (SELECT gid, a AS vid, sum(d) AS s FROM sp GROUP BY ALL)
SELECT e.gid, e.src, e.dst, round(1 / sqrt(x.s * y.s), 5) AS index FROM ge0 e JOIN s x ON x.gid = e.gid AND x.vid = e.src JOIN s y ON y.gid = e.gid AND y.vid = e.dst""")
def balaban_terms(spark, d):
    v, e = og.order_graphs(spark, d)
    return indices.edge_score(v, e, "balaban").join(e, ["gid", "eid"]).select("gid", "src", "dst", "index")


@query(f"""{_paths('1.0')}, z AS (SELECT gid, vid, ascii(vlb) % 10 + vid AS z FROM gv)
SELECT x.gid, x.vid, round(x.z + coalesce(sum((x.z - y.z) / pow(d + 1, 2)), 0), 5) AS index FROM z x LEFT JOIN sp ON sp.gid = x.gid AND sp.a = x.vid LEFT JOIN z y ON y.gid = sp.gid AND y.vid = sp.b GROUP BY x.gid, x.vid, x.z""")
def estate(spark, d):
    v, e = _numbered(spark, d)
    return indices.node_score(v, e, "estate").withColumn("index", F.round("index", 5))


@query(f"""{R}, dg AS (SELECT gid, src AS vid, count(*) AS degree FROM ge GROUP BY ALL), b AS (SELECT gv.gid, gv.vid, n, CASE WHEN n > 1 THEN coalesce(degree, 0) / (n - 1) ELSE 0 END AS b FROM gv JOIN gn USING (gid) LEFT JOIN dg ON dg.gid = gv.gid AND dg.vid = gv.vid),
ways AS (SELECT gid, src, dst, 1.0::DOUBLE AS w FROM ge UNION ALL SELECT gid, vid, vid, 0.0 FROM gv),
x AS (SELECT 0 AS k, gid, vid, CAST(b AS DOUBLE) AS x FROM b UNION ALL SELECT x.k + 1, ways.gid, ways.dst, b.b + sum(x.x * ways.w) / b.n FROM x JOIN ways ON ways.gid = x.gid AND ways.src = x.vid JOIN b ON b.gid = ways.gid AND b.vid = ways.dst WHERE x.k < 40 GROUP BY x.k, ways.gid, ways.dst, b.b, b.n)
SELECT x.gid, x.vid, round(x.x / (n * n), 8) AS index FROM x JOIN gn ON gn.gid = x.gid WHERE x.k = 40""")
def alpha_centrality(spark, d):
    return once(*og.order_graphs(spark, d), lambda v, e: indices.node_score(v, e, "alpha_centrality")).withColumn("index", F.round("index", 8))
