"""Hand-made graphs with goldens that were derived by hand and by exhaustive counting."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from graphset.functions import scores
from graphset.operators import assemble, fingerprint, indices, mining, rings, stats, tables, vectors
from graphset.operators.codes import canonical, is_min_code
from graphset.operators.mining import MiningConfig
from graphset.sources import text

TOY = {
    0: ("C C C C C C C C C C O", "0-1:1.0 1-2:1.0 2-3:1.0 3-4:1.0 4-5:2.0 5-6:1.0 6-7:2.0 7-8:1.0 8-9:2.0 4-9:1.0 9-10:1.0 1-10:1.0"),
    1: ("C C", "0-1:1.0"),
    2: ("C O C", "0-1:1.0 1-2:1.0"),
    3: ("C C C C C C", "0-1:2.0 1-2:1.0 2-3:2.0 3-4:1.0 4-5:2.0 0-5:1.0"),
    4: ("C C C O N C O S", "0-1:1.0 1-2:1.0 2-3:2.0 2-4:1.0 4-5:1.0 5-6:2.0 5-7:1.0 1-7:1.0"),
    5: ("C O", "0-1:1.0"),
}


@pytest.fixture(scope="module")
def toy(spark):
    vs = [(g, i, lab) for g, (v, _) in TOY.items() for i, lab in enumerate(v.split())]
    es = []
    for g, (_, e) in TOY.items():
        for i, x in enumerate(e.split()):
            ends, lab = x.split(":")
            a, b = map(int, ends.split("-"))
            es.append((g, i, a, b, lab))
    return spark.createDataFrame(vs, "gid long, vid int, vlb string"), spark.createDataFrame(es, "gid long, eid int, src int, dst int, elb string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_vertex_label_support(toy):
    assert rows(mining.frequent_vertex_labels(toy[0], 1)) == [("C", 6), ("N", 1), ("O", 4), ("S", 1)]


def test_one_edge_patterns(toy):
    got = {r[:3]: r[3:] for r in rows(mining.frequent_edges(*toy, 1))}
    assert got == {("C", "1.0", "C"): (4, 26), ("C", "1.0", "O"): (3, 5), ("C", "2.0", "C"): (2, 12), ("C", "1.0", "N"): (1, 2), ("C", "1.0", "S"): (1, 2), ("C", "2.0", "O"): (1, 2)}


def test_mining_counts_and_invariants(toy):
    patterns, places = mining.mine_frequent(*toy, MiningConfig(2, max_edges=5))
    found = patterns.collect()
    assert len(found) == 11 and len({p.code for p in found}) == 11
    assert sorted((p.support, p.embeddings) for p in found if p.num_edge == 2) == [(2, 4), (2, 10), (2, 13)]
    for p in found:
        assert is_min_code(p.code) and p.embeddings >= p.support
        assert mining.match_pattern(*toy, p.code).count() == p.embeddings
    assert mining.occurrences(places).filter("n < 1").count() == 0
    v, e = mining.code_to_graph(patterns)
    assert e.groupBy("code").count().count() == 11 and v.count() == sum(p.num_vert for p in found)


def test_size_bounds(toy):
    patterns, _ = mining.mine_frequent(*toy, MiningConfig(3, min_vertices=1, max_vertices=2))
    assert {(p.code, p.num_vert) for p in patterns.collect()} == {("C", 1), ("O", 1), ("0,1,C,1.0,C", 2), ("0,1,C,1.0,O", 2)}
    assert mining.describe(patterns).filter("code = '0,1,C,1.0,O'").first().description == "v 0 C v 1 O e 0 1 1.0"


def test_rings_and_junction_tree(toy):
    v, e = toy
    assert rows(rings.rings(e)) == [(0, [1, 2, 3, 4, 9, 10]), (0, [4, 5, 6, 7, 8, 9]), (3, [0, 1, 2, 3, 4, 5]), (4, [1, 2, 4, 5, 7])]
    cl = rings.cliques(v, e)
    sizes = {r.gid: r.n for r in cl.groupBy("gid").agg(F.count("*").alias("n")).collect()}
    assert sizes[0] == 3 and sizes[4] == 4
    tree = rings.max_spanning_tree(rings.clique_graph(cl))
    n = {r.gid: r.n for r in tree.groupBy("gid").agg(F.count("*").alias("n")).collect()}
    assert n[0] == 2 and n[4] == 3
    nodes = rings.tree_nodes(cl, tree)
    assert nodes.filter("is_root").count() == 6
    assert rings.clique_context(cl, tree).filter("gid = 1").count() == 2


def test_canonical_code_ignores_numbering():
    a = canonical({0: "C", 1: "C", 2: "O"}, [(0, 1, "1"), (1, 2, "1")])
    assert a == canonical({5: "O", 7: "C", 9: "C"}, [(9, 7, "1"), (7, 5, "1")]) != canonical({0: "C", 1: "O", 2: "C"}, [(0, 1, "1"), (1, 2, "1")])


def test_indices(toy):
    v, e = toy
    alpha = {(r.gid, r.vid): r["index"] for r in indices.alpha_centrality(v, e).collect()}
    assert alpha[1, 0] == pytest.approx(0.5) and alpha[1, 1] == pytest.approx(0.5)
    d = {(r.a, r.b): r.d for r in indices.shortest_paths(v, e).filter("gid = 3").collect()}
    assert d[0, 3] == 3 and d[0, 5] == 1
    with pytest.raises(ValueError):
        indices.node_score(v, e, "none")


def test_identifiers_tell_atoms_apart(toy):
    ids = fingerprint.identifiers(*toy, 2)
    assert ids.filter("gid = 3 AND r = 2").select("id").distinct().count() == 1
    assert ids.filter("gid = 2 AND r = 1").select("id").distinct().count() == 2
    assert fingerprint.dedup_environments(ids, *toy).filter("gid = 1").count() == 3
    s = {r.gid: r.tokens for r in fingerprint.sentences(ids).collect()}
    assert len(s[1]) == 6


def test_components_of_split_graph(spark, toy):
    v, e = toy
    cut = e.filter("NOT (gid = 2 AND eid = 1)")
    assert rows(rings.components(v, cut).filter("gid = 2")) == [(2, 0, 0), (2, 1, 0), (2, 2, 2)]
    assert rings.filter_components(v, cut, 1, "small").count() == 1


def test_graph_text_round_trip(spark, toy, tmp_path):
    v, e = toy
    text.write_graph_text(v, e, str(tmp_path / "g"))
    v2, e2 = text.read_graph_text(spark, str(tmp_path / "g"))
    assert rows(v2) == rows(v) and rows(e2) == rows(e)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.txt").write_text("t # 7\nv 0 A\nv 1 B\ne 0 1 x\nt # 9\nv 0 C")
    v3, _ = text.read_graph_text(spark, str(tmp_path / "h"))
    assert rows(v3) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C")]
    v4, _ = text.read_graph_text(spark, str(tmp_path / "h"), gid="label")
    assert {r.gid for r in v4.collect()} == {7, 9}


def test_small_readers(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CC\tx\nCO\ty\n")
    assert rows(text.read_smi(spark, str(tmp_path / "a.smi"))) == [("CC", "x"), ("CO", "y")]
    with pytest.raises(ValueError):
        text.read_smi(spark, str(tmp_path / "a.csv"))
    (tmp_path / "c.txt").write_text("a b  c\n")
    assert text.read_corpus(spark, str(tmp_path / "c.txt")).first().tokens == ["a", "b", "c"]
    raw = spark.createDataFrame([(0, ["1.5", "x", "y"]), (1, ["2.0", "y"])], "pos int, row array<string>")
    assert rows(text.read_fscores(raw)) == [("x", 1.5), ("y", 2.0)]


def test_merges(spark, toy):
    v, e = toy
    caps = spark.createDataFrame([("C", 4), ("N", 3), ("O", 2), ("S", 2)], "vlb string, cap int")
    pairs = spark.createDataFrame([(1, 5), (3, 3)], "base long, block long")
    cands, nv, ne = assemble.merge_nodes(v, e, v, e, pairs, caps)
    one = cands.filter("base = 1").count()
    assert one == 2 * 1 + 2 * 2  # two carbons meet a carbon once each, the oxygen with either survivor
    best = assemble.sanitize(cands, nv, ne, caps)
    assert best.filter("base = 1").count() == 4 - 1
    cands, nv, ne = assemble.merge_edges(v, e, v, e, pairs, caps)
    assert cands.count() == 6 * 12 and nv.groupBy("cand").count().filter("count <> 10").count() == 0
    steps = assemble.rollout(v.filter("gid = 1"), e.filter("gid = 1"), (v.filter("gid = 5"), e.filter("gid = 5")), caps, lambda a, b: a.groupBy("gid").agg((F.count("*") / 100).alias("score")), 2)
    assert [r.score for r in steps.orderBy("step").collect()] == [0.03, 0.04]
    assert assemble.trajectory_summary(steps).first().final == 0.04
    assert assemble.stop_before(steps, 0.035).first().step == 0


def test_tables(spark, toy):
    v, e = toy
    uv, ue = tables.disjoint_union(v.filter("gid = 1"), e.filter("gid = 1"), v.filter("gid = 1"), e.filter("gid = 1"))
    assert rows(ue.select("src", "dst")) == [(0, 1), (2, 3)] and uv.count() == 4
    assert rows(tables.label_dictionary(v)) == [("C", 0), ("N", 2), ("O", 1), ("S", 3)]
    nested = spark.createDataFrame([(1, ("x", 2.0))], "a int, b struct<c:string,d:double>")
    assert tables.flatten_numeric(nested).columns == ["a", "b/d"]
    with pytest.raises(ValueError):
        tables.require_columns(v, "nothing")
    assert tables.minsup(v, 0.5) == 3


def test_vectors(spark):
    tokens = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["z"]), (3, [])], "gid long, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.0]), ("UNK", [9.0, 9.0])], "token string, vector array<double>")
    assert rows(vectors.sentence_vectors(tokens, vec)) == [(1, [2.5, 4.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
    assert rows(vectors.sentence_vectors(tokens, vec, "UNK"))[1] == (2, [9.0, 9.0])
    assert {r.gid: r.tokens for r in vectors.insert_unk(tokens, 1).collect()} == {1: ["a", "a", "UNK"], 2: ["UNK"]}
    with pytest.raises(ValueError):
        vectors.GraphVec().transform(tokens)
    many = spark.createDataFrame([(i, ["a", "b", "c"] * 4) for i in range(20)], "gid long, tokens array<string>")
    model = vectors.GraphVec(size=4, window=2, minCount=1).fit(many)
    assert model.transform(many).filter("size(vector) = 4").count() == 20


def test_scores(spark):
    df = spark.createDataFrame([(10, 5, 0.0), (5, 5, -9.0)], "n int, m int, raw double")
    got = df.select(scores.density_bonus(F.col("n"), F.col("m")).alias("b"), scores.sa_score(F.col("raw")).alias("s")).collect()
    assert got[0].b == pytest.approx(0.5 * math.log(2)) and got[1].b == 0
    assert got[0].s == pytest.approx(11 - 5 / 6.5 * 9) and got[1].s == 10.0


def test_stats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 2.0)], "id int, k string, x double")
    assert rows(stats.best_by(df, "k", "x", "id").select("id")) == [(2,), (3,)]
    assert rows(stats.count_ids(spark.createDataFrame([("1,2,1",)], "ids string"), "ids")) == [("1", 2), ("2", 1)]
    drawn = stats.sample_rows(df, 20, 3, "id")
    assert drawn.count() == 20 and rows(drawn) == rows(stats.sample_rows(df, 20, 3, "id"))
    assert rows(stats.class_ranges(df, "k", "x").select("k", "n")) == [("a", 2)]
