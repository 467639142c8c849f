"""Queries of the basic table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphset.operators import mining, rings, stats, tables
from graphset.plans import order_graphs as og
from graphset.plans.order_graphs import table
from graphset.sources import text
from graphset.storage import scratch_dir

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


@query(f"{G} SELECT gid, vid, vlb FROM gv")
def graphs_from_tables(spark, d):
    line = table(spark, d, "lineitem")
    return tables.graphs_from_tables(line, "l_orderkey", og.LINE_ORDER, F.concat("l_returnflag", "l_linestatus"))


@query(f"{G} SELECT gid, src, dst, elb FROM ge0")
def order_edges(spark, d):
    return og.order_edges(spark, d).drop("eid")


@query(f"{G} SELECT gid, CAST(row_number() OVER (PARTITION BY gid ORDER BY src, dst, elb) - 1 AS INT) AS eid, src, dst, elb FROM ge0")
def number_edges(spark, d):
    return tables.number_edges(og.order_edges(spark, d).drop("eid"))


@query(f"{G} SELECT gid, vid, vlb FROM gv WHERE gid < 1000")
def limit_graphs(spark, d):
    return tables.limit_graphs(og.order_vertices(spark, d), 1000)


@query(f"""{G} SELECT gid, vid, CASE vlb WHEN 'RF' THEN 'returned' WHEN 'NO' THEN 'new' ELSE vlb END AS vlb FROM gv""")
def normalize_graphs(spark, d):
    v, e = og.order_graphs(spark, d)
    shifted = v.withColumn("vid", F.col("vid") + 5)
    moved = e.withColumns({"src": F.col("src") + 5, "dst": F.col("dst") + 5})
    names = spark.createDataFrame([("RF", "returned"), ("NO", "new")], "label string, name string")
    return tables.normalize_graphs(shifted, moved, names)[0]


@query(f"{G} SELECT gid, src, dst, CASE elb WHEN '1' THEN 'single' ELSE elb END AS elb FROM ge0")
def normalize_edges(spark, d):
    v, e = og.order_graphs(spark, d)
    moved = e.withColumns({"src": F.col("src") + 5, "dst": F.col("dst") + 5})
    names = spark.createDataFrame([("1", "single")], "label string, name string")
    return tables.normalize_graphs(v.withColumn("vid", F.col("vid") + 5), moved.drop("eid"), emap=names)[1]


@query("""SELECT user_id AS gid, CAST(hour(ts) AS INT) AS vid, arg_min(event_type, (ts, event_id)) AS vlb FROM events GROUP BY ALL""")
def dedup_vertices(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("gid"), F.hour("ts").alias("vid"), F.col("event_type").alias("vlb"), F.struct("ts", "event_id").alias("pos"))
    return tables.dedup_vertices(e, "pos")


@query("""WITH a AS (SELECT user_id AS gid, ts, event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst,
CAST(hour(ts) AS VARCHAR) AS elb FROM events) SELECT gid, src, dst, arg_max(elb, (ts, event_id)) AS elb FROM a WHERE dst IS NOT NULL GROUP BY ALL""")
def dedup_edges(spark, d):
    return tables.dedup_edges(og.event_arcs(spark, d), "pos")


@query(f"{G} SELECT gid, src, dst, elb FROM ge")
def symmetrize(spark, d):
    return tables.symmetrize(og.order_edges(spark, d).drop("eid"))


@query(f"{G} SELECT gid, least(src, dst) AS src, greatest(src, dst) AS dst, elb FROM ge")
def orient(spark, d):
    return tables.orient(tables.symmetrize(og.order_edges(spark, d).drop("eid")))


@query("SELECT n_name AS key, n_nationkey AS value FROM nation")
def invert_map(spark, d):
    return tables.invert_map(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), "key", "value")


@query(f"{G} SELECT gid, vid, vlb FROM gv UNION ALL SELECT gid, CAST(vid + n AS INT), vlb FROM gv JOIN gn USING (gid)")
def disjoint_union(spark, d):
    v, e = og.order_graphs(spark, d)
    return tables.disjoint_union(v, e, v, e)[0]


@query(f"{G} SELECT gid, src, dst, elb FROM ge0 UNION ALL SELECT gid, CAST(src + n AS INT), CAST(dst + n AS INT), elb FROM ge0 JOIN gn USING (gid)")
def disjoint_union_edges(spark, d):
    v, e = og.order_graphs(spark, d)
    return tables.disjoint_union(v, e.drop("eid"), v, e.drop("eid"))[1]


@query("""SELECT l_orderkey AS gid, l_suppkey AS piece, CAST(count(*) AS BIGINT) AS n,
CAST(coalesce(sum(count(*)) OVER (PARTITION BY l_orderkey ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id
FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def offset_ids(spark, d):
    pieces = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("gid"), F.col("l_suppkey").alias("piece")).agg(F.count("*").alias("n"))
    return tables.offset_ids(pieces)


@query(f"""{G}, k AS (SELECT gid, vid, vlb, CAST(row_number() OVER (PARTITION BY gid ORDER BY vid) - 1 AS INT) AS nid FROM gv WHERE vlb <> 'NO')
SELECT e.gid, a.nid AS src, b.nid AS dst, e.elb FROM ge0 e JOIN k a ON a.gid = e.gid AND a.vid = e.src JOIN k b ON b.gid = e.gid AND b.vid = e.dst""")
def relabel(spark, d):
    v, e = og.order_graphs(spark, d)
    return tables.relabel(v.filter("vlb <> 'NO'"), e.drop("eid"))[1]


@query(f"""{G}, f AS (SELECT gid, vlb, min(vid) AS pos FROM gv GROUP BY gid, vlb) SELECT gid, string_agg(vlb, ',' ORDER BY pos) AS labels FROM f GROUP BY gid""")
def distinct_labels(spark, d):
    return tables.distinct_labels(og.order_vertices(spark, d)).withColumn("labels", F.array_join("labels", ","))


DICTIONARY = "dict AS (SELECT vlb, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS label_id FROM (SELECT vlb, min((gid, vid)) AS first FROM gv GROUP BY vlb))"


@query(f"{G}, {DICTIONARY} SELECT vlb, label_id FROM dict")
def label_dictionary(spark, d):
    return tables.label_dictionary(og.order_vertices(spark, d))


@query(f"{G}, {DICTIONARY} SELECT gid, vid, label_id FROM gv JOIN dict USING (vlb)")
def encode_labels(spark, d):
    v = og.order_vertices(spark, d)
    return tables.encode_labels(v, tables.label_dictionary(v))


@query(f"{G} SELECT gid, vid, vlb FROM gv")
def decode_labels(spark, d):
    v = og.order_vertices(spark, d)
    names = tables.label_dictionary(v)
    return tables.decode_labels(tables.encode_labels(v, names), names)


@query(f"{G}, dg AS (SELECT gid, src AS vid, count(*) AS degree FROM ge GROUP BY ALL) SELECT gid, vid, concat('0.', vlb, '.', coalesce(degree, 0)) AS vlb FROM gv LEFT JOIN dg USING (gid, vid)")
def vertex_features(spark, d):
    return tables.vertex_features(*og.order_graphs(spark, d))


@query(f"""{G}, dg AS (SELECT gid, src AS vid, count(*) AS degree FROM ge GROUP BY ALL), tri AS (SELECT DISTINCT gid, vid FROM gv JOIN gn USING (gid) WHERE n >= 3)
SELECT gv.gid, gv.vid, concat(CASE WHEN tri.gid IS NULL THEN 0 ELSE 1 END, '.', vlb, '.', coalesce(degree, 0)) AS vlb FROM gv LEFT JOIN dg ON dg.gid = gv.gid AND dg.vid = gv.vid LEFT JOIN tri ON tri.gid = gv.gid AND tri.vid = gv.vid""")
def vertex_features_in_rings(spark, d):
    """With the flag of rings: the line of an order and its closing edge make a ring of three vertices and more."""
    v, e = og.order_graphs(spark, d)
    ring = rings.rings(e).select("gid", F.explode("ring").alias("vid"))
    return tables.vertex_features(v, e, in_ring=ring)


@query(f"""{G}, dg AS (SELECT gid, src AS vid, count(*) AS degree, sum(CAST(elb AS DOUBLE)) AS ev FROM ge GROUP BY ALL),
q AS (SELECT l_orderkey AS gid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INT) AS vid, CAST(l_linenumber AS INT) AS number FROM lineitem),
f AS (SELECT gv.*, coalesce(degree, 0) AS degree, coalesce(ev, 0) AS ev, CASE vlb[1] WHEN 'R' THEN 4 WHEN 'N' THEN 3 END AS cap, number FROM gv JOIN q USING (gid, vid) LEFT JOIN dg USING (gid, vid))
SELECT gid, vid, concat('0.', vlb, '.', degree, '.', CAST(ev AS VARCHAR), '.', coalesce(CAST(CAST(cap - ev AS DOUBLE) AS VARCHAR), '-'), '.', number) AS vlb FROM f""")
def vertex_features_full(spark, d):
    """Flag, label, degree, sum of bonds, free valence (labels of A have no cap) and a number of the line."""
    v = og.sized_vertices(spark, d, "l_linenumber")
    first = F.substring("vlb", 1, 1)
    caps = v.select("vlb").distinct().select("vlb", F.when(first == "R", 4).when(first == "N", 3).alias("cap"))
    return tables.vertex_features(v.withColumn("number", F.col("l_linenumber").cast("int")), og.order_edges(spark, d), caps=caps, more=("number",))


@query(f"{G}, dg AS (SELECT gid, src AS vid, count(*) AS degree FROM ge GROUP BY ALL) SELECT gv.gid, gv.vid, concat(lower(vlb), '/', coalesce(degree, 0)) AS vlb FROM gv LEFT JOIN dg USING (gid, vid)")
def vertex_features_by_function(spark, d):
    return tables.vertex_features(*og.order_graphs(spark, d), mode=lambda: F.concat(F.lower("vlb"), F.lit("/"), F.col("degree").cast("string")))


@query("""WITH a AS (SELECT l_orderkey AS gid, round(sum(CAST(l_quantity AS DOUBLE)), 6) AS total FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS gid, round(sum(CAST(o_custkey AS DOUBLE)), 6) AS total FROM orders GROUP BY ALL)
SELECT 'a' AS side, gid, total FROM a WHERE total IN (SELECT total FROM b) UNION ALL SELECT 'b', gid, total FROM b WHERE total IN (SELECT total FROM a)""")
def weight_classes(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_quantity").cast("double").alias("w"))
    return tables.weight_classes(a, table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").cast("double").alias("w")))


@query(f"{G} SELECT e.gid, src, dst, elb FROM ge0 e JOIN gv a ON a.gid = e.gid AND a.vid = src JOIN gv b ON b.gid = e.gid AND b.vid = dst WHERE a.vlb = 'NO' AND b.vlb = 'NO'")
def induced_subgraph(spark, d):
    v, e = og.order_graphs(spark, d)
    return tables.induced_subgraph(v, e, v.filter("vlb = 'NO'"))[1].drop("eid")


@query(f"{G} SELECT e.gid, e.src, e.dst, e.elb, a.vlb AS slb, b.vlb AS dlb FROM ge0 e JOIN gv a ON a.gid = e.gid AND a.vid = e.src JOIN gv b ON b.gid = e.gid AND b.vid = e.dst")
def with_labels(spark, d):
    return tables.with_labels(*og.order_graphs(spark, d)).drop("eid")


@query(f"{G} SELECT gid, src, dst, CAST(elb AS DOUBLE) AS weight FROM ge0")
def typed_edges(spark, d):
    return tables.typed_edges(og.order_edges(spark, d))


@query(f"""{G} SELECT v.gid, v.n_vertices, coalesce(e.n_edges, 0) AS n_edges, v.n_labels FROM
(SELECT gid, count(*) AS n_vertices, count(DISTINCT vlb) AS n_labels FROM gv GROUP BY gid) v LEFT JOIN (SELECT gid, count(*) AS n_edges FROM ge0 GROUP BY gid) e USING (gid)""")
def graph_summary(spark, d):
    return tables.graph_summary(*og.order_graphs(spark, d))


@query(f"{G} SELECT gid, src AS vid, string_agg(concat(dst, ':', elb), ',' ORDER BY dst, elb) AS neighbours FROM ge GROUP BY ALL")
def adjacency(spark, d):
    return tables.adjacency(og.order_edges(spark, d)).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["dst"], x["elb"])), ","))


@query(f"{G} SELECT gid, src AS vid, " + ", ".join(f"coalesce(sum(CASE WHEN dst = {i} THEN CAST(elb AS DOUBLE) END), 0) AS d{i}" for i in range(4)) + " FROM ge GROUP BY ALL")
def to_matrix(spark, d):
    return tables.to_matrix(og.order_edges(spark, d), 4).withColumnsRenamed({str(i): f"d{i}" for i in range(4)})


@query(f"""{G}, w AS (SELECT gid, src, dst, sum(CAST(elb AS DOUBLE)) AS weight FROM ge GROUP BY ALL), r AS (SELECT DISTINCT gid, src AS vid FROM ge), c AS (SELECT gid, unnest(range(max(src) + 1)) AS dst FROM ge GROUP BY gid)
SELECT r.gid, r.vid, string_agg(CAST(CAST(coalesce(weight, 0) AS INT) AS VARCHAR), ',' ORDER BY c.dst) AS row FROM r JOIN c USING (gid) LEFT JOIN w ON w.gid = r.gid AND w.src = r.vid AND w.dst = c.dst GROUP BY ALL""")
def adjacency_rows(spark, d):
    return tables.adjacency_rows(og.order_edges(spark, d)).withColumn("row", F.array_join(F.transform("row", lambda x: x.cast("int").cast("string")), ","))


@query(f"{G} SELECT vlb, gid, string_agg(CAST(vid AS VARCHAR), ',' ORDER BY vid) AS vids FROM gv GROUP BY ALL")
def label_index(spark, d):
    return tables.label_index(og.order_vertices(spark, d)).withColumn("vids", F.array_join("vids", ","))


@query(f"{G} SELECT elb, gid, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS eids FROM ge0 GROUP BY ALL")
def edge_label_index(spark, d):
    return tables.edge_label_index(og.order_edges(spark, d)).withColumn("eids", F.array_join("eids", ","))


@query("""WITH a AS (SELECT l_orderkey AS gid, round(sum(CAST(l_quantity AS DOUBLE)), 6) AS total FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS gid, round(CAST(o_custkey AS DOUBLE), 6) AS total FROM orders)
SELECT a.gid AS gid_a, b.gid AS gid_b, a.total FROM a JOIN b USING (total)""")
def same_weight(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_quantity").cast("double").alias("w"))
    return tables.same_weight(a, table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").cast("double").alias("w")))


@query("SELECT doc_id, text FROM documents WHERE length(text) >= 50")
def filter_blocks(spark, d):
    return tables.filter_blocks(tables.drop_invalid(table(spark, d, "documents").select("doc_id", "text"), "text"), "text", 50)


@query(f"{G} SELECT CAST(floor(count(DISTINCT gid) * 0.05) AS BIGINT) AS support FROM gv")
def minsup(spark, d):
    return spark.range(1).select(F.lit(tables.minsup(og.order_vertices(spark, d), 0.05)).cast("long").alias("support"))


@query('SELECT o_orderkey AS "a/k", CAST(o_totalprice AS DOUBLE) AS "a/b/price" FROM orders')
def flatten_numeric(spark, d):
    o = table(spark, d, "orders")
    return tables.flatten_numeric(o.select(F.struct(F.col("o_orderkey").alias("k"), F.struct(F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("s")).alias("b")).alias("a")))


@query(f"""{G}, o AS (SELECT gid, CAST(dense_rank() OVER (ORDER BY gid) - 1 AS BIGINT) AS k FROM gn) SELECT o.k AS gid, src, dst, elb FROM ge0 JOIN o USING (gid)""")
def graph_text_round_trip(spark, d):
    import uuid

    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    v, e = og.order_graphs(spark, d)
    text.write_graph_text(v, e, path)
    return text.read_graph_text(spark, path)[1].drop("eid")


def _file(spark):
    import uuid

    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT p_partkey AS id, p_name AS block FROM part")
def read_blocks(spark, d):
    path = _file(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("block")).write.option("header", True).csv(path)
    return text.read_blocks(spark, path)


@query("SELECT p_name AS value FROM part")
def read_lines(spark, d):
    path = _file(spark)
    table(spark, d, "part").select(F.col("p_name").alias("value")).write.text(path)
    return text.read_lines(spark, path)


@query("SELECT p_name AS smiles, CAST(p_partkey AS VARCHAR) AS id FROM part")
def read_smi(spark, d):
    path = _file(spark) + ".smi"
    table(spark, d, "part").select("p_name", F.col("p_partkey").cast("string")).write.option("sep", "\t").option("compression", "gzip").csv(path)
    return text.read_smi(spark, path)


@query("SELECT md5(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(text, '[\\n\\r]', ' ', 'g'), ' '), '\\s+'), lambda x: true), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def corpus_round_trip(spark, d):
    """Sentences written a line each, and read again."""
    path = _file(spark)
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select(F.split(F.regexp_replace("text", "[\\n\\r]", " "), " ").alias("tokens"))
    text.write_corpus(lines, path)
    return text.read_corpus(spark, path).select(F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS fid, arg_max(CAST(l_orderkey AS DOUBLE), l_orderkey) AS score FROM lineitem GROUP BY l_partkey")
def read_fscores(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return text.read_fscores(rows.select(F.col("l_orderkey").alias("pos"), F.concat(F.array(F.col("l_orderkey").cast("string")), "ids").alias("row")))


@query(f"{G}, {DICTIONARY} SELECT vlb, CAST(label_id AS BIGINT) AS label_id FROM dict")
def vocab_round_trip(spark, d):
    path = _file(spark)
    text.write_vocab(tables.label_dictionary(og.order_vertices(spark, d)), path)
    return spark.read.option("header", True).schema("vlb string, label_id long").csv(path)


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS a, round(CAST(embedding[2] AS DOUBLE), 5) AS b FROM embeddings")
def features_round_trip(spark, d):
    path = _file(spark)
    text.write_features(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.select(F.col("vec_id").cast("long").alias("vec_id"), F.round("feature-000", 5).alias("a"), F.round("feature-001", 5).alias("b"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS score FROM orders")
def results_round_trip(spark, d):
    path = _file(spark)
    text.write_results(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("score")), path)
    return spark.read.option("header", True).schema("o_orderkey long, score double").csv(path)


@query(f"""{G}, la AS (SELECT e.gid, e.elb, a.vlb AS slb, b.vlb AS dlb FROM ge e JOIN gv a ON a.gid = e.gid AND a.vid = e.src JOIN gv b ON b.gid = e.gid AND b.vid = e.dst)
SELECT concat_ws(',', '0', '1', slb, elb, dlb) AS code, gid, count(*) AS n FROM la WHERE slb <= dlb GROUP BY ALL""")
def mining_round_trip(spark, d):
    """A mining result written and read again, as tables; and as CSV, which is read for its patterns."""
    path = _file(spark)
    patterns, places = mining.mine_frequent(*og.order_graphs(spark, d), mining.MiningConfig(1, max_edges=1))
    text.save_mining(patterns, mining.occurrences(places), path)
    patterns, occ = text.load_mining(spark, path)
    text.write_patterns(patterns, occ, path + "-csv")
    listed = spark.read.option("header", True).csv(path + "-csv/patterns").select("code")
    return occ.join(listed, "code", "left_semi")


@query("SELECT id, count(*) AS n FROM (SELECT unnest(string_split(ids, ',')) AS id FROM (SELECT string_agg(CAST(l_partkey AS VARCHAR), ',') AS ids FROM lineitem GROUP BY l_orderkey)) GROUP BY id")
def count_ids(spark, d):
    joined = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ",").alias("ids"))
    return stats.count_ids(joined, "ids")


@query("SELECT round(avg(p), 6) AS mean, count(*) AS n FROM (SELECT CAST(o_totalprice AS DOUBLE) AS p FROM orders ORDER BY p DESC, o_orderkey LIMIT 100)")
def top_k_mean(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("p"))
    return stats.top_k_mean(o, "p", "o_orderkey").withColumn("mean", F.round("mean", 6))


@query("SELECT o_custkey, o_orderkey, p FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DOUBLE) DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_by(spark, d):
    return stats.best_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("p")), "o_custkey", "p", "o_orderkey")


@query()
def sample_rows(spark, d):
    return stats.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 1000, 7, "o_orderkey")


@query("SELECT event_type, round(a - (b - a) * 0.1, 6) AS low, round(b + (b - a) * 0.1, 6) AS high, n FROM (SELECT event_type, min(value) AS a, max(value) AS b, count(*) AS n FROM events GROUP BY event_type) WHERE n > 1")
def class_ranges(spark, d):
    return stats.class_ranges(table(spark, d, "events"), "event_type", "value").withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("""WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) AS sd FROM events GROUP BY event_type), g AS (SELECT unnest([0.0, 25.0, 50.0, 75.0, 100.0])::DOUBLE AS x)
SELECT event_type, x, round(sum(exp(-0.5 * pow((x - value) / (sd * pow(n, -0.2)), 2)) / (n * sd * pow(n, -0.2) * sqrt(2 * pi()))), 6) AS density FROM events JOIN s USING (event_type), g GROUP BY ALL""")
def kde(spark, d):
    return stats.kde(table(spark, d, "events"), "event_type", "value", [0.0, 25.0, 50.0, 75.0, 100.0]).withColumn("density", F.round("density", 6))
