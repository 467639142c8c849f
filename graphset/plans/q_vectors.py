"""Queries of fingerprints, corpora and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphset.operators import fingerprint, vectors
from graphset.operators import neighbour_map as nm
from graphset.operators.alike import alike
from graphset.plans import order_graphs as og
from graphset.plans.order_graphs import table
from graphset.storage import save

G = f"WITH {og.SQL}"
QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IDS = f"""{G}, i0 AS (SELECT gid, vid, 0 AS r, md5(vlb) AS id FROM gv),
i1 AS (SELECT a.gid, a.vid, 1 AS r, md5(concat(a.id, '|', coalesce(string_agg(e.elb || ':' || b.id, ',' ORDER BY e.elb || ':' || b.id), ''))) AS id
  FROM i0 a LEFT JOIN ge e ON e.gid = a.gid AND e.src = a.vid LEFT JOIN i0 b ON b.gid = e.gid AND b.vid = e.dst GROUP BY a.gid, a.vid, a.id),
ids AS (SELECT * FROM i0 UNION ALL SELECT * FROM i1)"""


def _ids(spark, d):
    return fingerprint.identifiers(*og.order_graphs(spark, d), 1)


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("gid"), F.split(F.trim("text"), " ").alias("tokens"))


@query(f"{IDS} SELECT gid, vid, r, id FROM ids")
def identifiers(spark, d):
    return _ids(spark, d)


@query(f"""{G}, b1 AS (SELECT gid, vid, vid AS near FROM gv UNION SELECT gid, src, dst FROM ge)
SELECT gid, vid, near FROM b1 UNION SELECT b1.gid, b1.vid, ge.dst FROM b1 JOIN ge ON ge.gid = b1.gid AND ge.src = b1.near""")
def neighborhood(spark, d):
    return fingerprint.neighborhood(*og.order_graphs(spark, d), 2)


@query(f"{G} SELECT gid, src AS vid, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS edges FROM ge GROUP BY ALL")
def ball_edges(spark, d):
    return fingerprint.ball_edges(*og.order_graphs(spark, d), 1).withColumn("edges", F.array_join("edges", ","))


@query(f"""{IDS}, balls AS (SELECT gid, src AS vid, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS edges FROM ge GROUP BY ALL),
k AS (SELECT i.*, row_number() OVER (PARTITION BY i.gid, edges ORDER BY r, id, vid) AS k FROM i1 i JOIN balls USING (gid, vid))
SELECT gid, vid, r, id FROM i0 UNION ALL SELECT gid, vid, r, id FROM k WHERE k = 1""")
def dedup_environments(spark, d):
    v, e = og.order_graphs(spark, d)
    return fingerprint.dedup_environments(_ids(spark, d), v, e)


@query(f"{IDS} SELECT gid, string_agg(id, ' ' ORDER BY vid, r) AS sentence FROM ids GROUP BY gid")
def sentences(spark, d):
    return fingerprint.sentences(_ids(spark, d)).select("gid", F.array_join("tokens", " ").alias("sentence"))


@query(f"{IDS} SELECT gid, r, string_agg(id, ' ' ORDER BY vid) AS sentence FROM ids GROUP BY gid, r")
def sentences_per_radius(spark, d):
    return fingerprint.sentences(_ids(spark, d), "per_radius").select("gid", "r", F.array_join("tokens", " ").alias("sentence"))


@query(f"{IDS} SELECT gid, vid, r FROM ids WHERE id = md5('RF')")
def locate(spark, d):
    import hashlib

    return fingerprint.locate(_ids(spark, d), hashlib.md5(b"RF").hexdigest())


@query(f"{IDS} SELECT gid, id, count(*) AS n FROM ids GROUP BY ALL")
def wl_features(spark, d):
    return fingerprint.wl_features(*og.order_graphs(spark, d), 1)


@query(f"{IDS} SELECT id, min(gid) AS gid FROM ids GROUP BY id")
def first_occurrence(spark, d):
    return fingerprint.first_occurrence(_ids(spark, d))


@query(f"""{IDS}, t AS (SELECT DISTINCT id FROM ids WHERE gid = 1), o AS (SELECT DISTINCT gid, id FROM ids)
SELECT gid, round(count(t.id) / (count(*) + (SELECT count(*) FROM t) - count(t.id)), 6) AS similarity FROM o LEFT JOIN t USING (id) GROUP BY gid""")
def tanimoto(spark, d):
    ids = _ids(spark, d)
    return fingerprint.tanimoto(ids, ids.filter("gid = 1")).withColumn("similarity", F.round("similarity", 6))


@query(f"""{IDS}, s AS (SELECT gid, list_sort(list(DISTINCT id)) AS ids FROM ids GROUP BY gid), c AS (SELECT min(gid) AS g, ids, len(ids) AS n FROM s GROUP BY ids),
x AS (SELECT g, n, unnest(ids) AS id FROM c), p AS (SELECT x.g AS a, y.g AS b, x.n AS na, y.n AS nb, count(*) AS k FROM x JOIN x y ON x.id = y.id AND x.g < y.g GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM p WHERE k / (na + nb - k) >= 0.75""")
def similar_pairs(spark, d):
    # classes of equal sets are named by their smallest gid, which is among the smallest of those that are alike
    some = alike(*og.written_graphs(spark, d), written=True)
    return fingerprint.similar_pairs(fingerprint.identifiers(some.v, some.e, 1), 0.75).withColumn("similarity", F.round("similarity", 6))


@query(f"""{IDS}, s AS (SELECT gid, list_sort(list(DISTINCT id)) AS ids FROM ids GROUP BY gid) SELECT gid, min(gid) OVER (PARTITION BY ids) AS class FROM s""")
def similar_classes(spark, d):
    return fingerprint.similar_classes(_ids(spark, d))


WORDS = "w AS (SELECT doc_id AS gid, unnest(string_split(trim(text, ' '), ' ')) AS token, generate_subscripts(string_split(trim(text, ' '), ' '), 1) AS pos FROM documents)"


@query(f"WITH {WORDS} SELECT token, count(*) AS n FROM w GROUP BY token")
def token_counts(spark, d):
    return vectors.token_counts(corpus(spark, d))


@query(f"""WITH {WORDS}, c AS (SELECT token, count(*) AS n FROM w GROUP BY token)
SELECT gid, md5(string_agg(CASE WHEN n > 3 THEN token ELSE 'UNK' END, ' ' ORDER BY pos)) AS digest FROM w JOIN c USING (token) GROUP BY gid""")
def insert_unk(spark, d):
    return vectors.insert_unk(corpus(spark, d)).select("gid", F.md5(F.array_join("tokens", " ")).alias("digest"))


def _part_sentences(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), (F.col("l_partkey") % 600).cast("string").alias("t"))
    return line.groupBy("gid").agg(F.collect_list("t").alias("tokens"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))


SUMS = """WITH t AS (SELECT l_orderkey AS gid, l_partkey % 600 AS token FROM lineitem), v AS (SELECT vec_id AS token, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT gid, pos, sum(x) AS x FROM t JOIN v USING (token) GROUP BY ALL), g AS (SELECT DISTINCT gid, pos FROM t, (SELECT DISTINCT pos FROM v))"""


@query(f"{SUMS} SELECT gid, CAST(pos AS INT) AS pos, CASE WHEN abs(coalesce(x, 0)) < 5e-6 THEN 0.0::DOUBLE ELSE round(x, 5) END AS x FROM g LEFT JOIN s USING (gid, pos)")
def sentence_vectors(spark, d):
    whole = vectors.sentence_vectors(_part_sentences(spark, d), _vectors(spark, d))
    return whole.select("gid", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.when(F.abs("x") < 5e-6, F.lit(0.0)).otherwise(F.round("x", 5)))


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def mean_vector(spark, d):
    e = table(spark, d, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    return vectors.mean_vector(e, ["label"]).withColumn("mean", F.round("mean", 6))


@query("""SELECT label, vec_id, CAST(pos - 1 AS INT) AS pos, round(coalesce(sum(CAST(x AS DOUBLE)) OVER (PARTITION BY label, pos ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS start
FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def running_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    return vectors.running_vectors(e, "label", "vec_id").withColumn("start", F.round("start", 5))


@query(f"""{IDS}, balls AS (SELECT gid, src AS vid, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS edges FROM ge GROUP BY ALL),
k AS (SELECT i.*, row_number() OVER (PARTITION BY i.gid, edges ORDER BY r, id, vid) AS k FROM i1 i JOIN balls USING (gid, vid)), kept AS (SELECT gid, id FROM i0 UNION ALL SELECT gid, id FROM k WHERE k = 1),
c AS (SELECT gid, count(*) FILTER (id IN (SELECT md5(vlb) FROM gv)) AS known, count(*) AS n FROM kept GROUP BY gid)
SELECT o_orderkey AS gid, o_custkey, CAST(1.0 * known + 0.5 * (n - known) AS DOUBLE) AS "f-000", CAST(n - known AS DOUBLE) AS "f-001" FROM orders LEFT JOIN c ON c.gid = o_orderkey""")
def featurize(spark, d):
    """Vectors of two numbers: labels have (1, 0), every other identifier that of UNK, (0.5, 1)."""
    v, e = og.order_graphs(spark, d)
    v, e = save(v), save(e)
    words = v.select(F.md5("vlb").alias("token")).distinct().withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), "o_custkey")
    unk = words.limit(1).select(F.lit("UNK").alias("token"), F.array(F.lit(0.5), F.lit(1.0)).alias("vector"))
    return vectors.featurize(rows, v, e, save(words.unionByName(unk)), prefix="f-")


@query()
def word2vec_graph_vectors(spark, d):
    # fitting and transforming read the sentences several times
    tokens = save(fingerprint.sentences(fingerprint.identifiers(*og.written_graphs(spark, d), 1)))
    return vectors.GraphVec(size=16, window=5, minCount=3, iterations=2).fit(tokens).transform(tokens)


@query()
def project_2d(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.project_2d(e).select("vec_id", "x", "y")


@query()
def neighbour_map(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nm.neighbour_map(e)
