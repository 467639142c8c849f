"""Graph operators that must not cut their results: cases in which a cut would show."""

from __future__ import annotations

import hashlib
import itertools

import pytest

from graphset import storage
from graphset.operators import fingerprint, mining, rings, tables, vectors
from graphset.operators.codes import canonical, graph_of
from graphset.operators.mining import MiningConfig
from graphset.sources import text

STAR = "gid long, eid int, src int, dst int, elb string"


def test_adjacency_rows_hold_every_column(spark):
    e = spark.createDataFrame([(1, 0, 0, 1, "1"), (1, 1, 0, 6, "2"), (1, 2, 5, 6, "1"), (1, 3, 5, 6, "1"), (2, 0, 0, 1, "3")], STAR)
    got = {(r.gid, r.vid): r.row for r in tables.adjacency_rows(e).collect()}
    want = {(1, 0): {1: 1.0, 6: 2.0}, (1, 1): {0: 1.0}, (1, 5): {6: 2.0}, (1, 6): {0: 2.0, 5: 2.0}, (2, 0): {1: 3.0}, (2, 1): {0: 3.0}}
    size = {1: 7, 2: 2}
    assert got == {k: [x.get(i, 0.0) for i in range(size[k[0]])] for k, x in want.items()}


def connected(edges):
    reach, rest = set(edges[0][:2]), list(edges[1:])
    while more := [e for e in rest if reach & set(e[:2])]:
        reach |= {x for e in more for x in e[:2]}
        rest = [e for e in rest if e not in more]
    return not rest


def test_mining_without_a_bound_equals_brute_force(spark):
    graphs = {
        0: ("AABAB", [(0, 1, "1"), (1, 2, "1"), (2, 3, "1"), (3, 4, "1"), (0, 4, "2"), (0, 3, "1")]),
        1: ("BABAA", [(4, 3, "1"), (3, 2, "1"), (2, 1, "1"), (1, 0, "1"), (4, 0, "2"), (4, 1, "1")]),
        2: ("AAB", [(0, 1, "1"), (1, 2, "1"), (0, 2, "1")]),
    }
    v = spark.createDataFrame([(g, i, x) for g, (vs, _) in graphs.items() for i, x in enumerate(vs)], "gid long, vid int, vlb string")
    e = spark.createDataFrame([(g, i, *x) for g, (_, es) in graphs.items() for i, x in enumerate(es)], STAR)
    lies = {}
    for g, (vs, es) in graphs.items():
        for n in range(1, len(es) + 1):
            for part in itertools.combinations(es, n):
                if connected(part):
                    lies.setdefault(canonical({x: vs[x] for p in part for x in p[:2]}, list(part)), set()).add(g)
    want = {c: len(gs) for c, gs in lies.items() if len(gs) >= 2}
    got = {canonical(*graph_of(r.code)): r.support for r in mining.mine_frequent(v, e, MiningConfig(2))[0].collect()}
    assert got == want and max(len(graph_of(c)[1]) for c in got) == 6


def test_uncapped_mining_is_registered():
    from graphset.queries import queries

    assert "mine_frequent_all" in queries()


def directed_form(arcs, labels):
    """The same text for isomorphic directed graphs: the least over all numberings."""
    vs = sorted({x for a in arcs for x in a[:2]})
    forms = []
    for p in itertools.permutations(range(len(vs))):
        name = dict(zip(vs, p, strict=True))
        forms.append(str(sorted((name[a], name[b], lab) for a, b, lab in arcs)) + str([labels[v] for v in sorted(vs, key=name.get)]))
    return min(forms)


def test_directed_mining_without_a_bound_equals_brute_force(spark):
    graphs = {
        0: ("AABA", [(0, 1, "1"), (1, 2, "1"), (2, 0, "2"), (2, 3, "1"), (3, 2, "1")]),
        1: ("ABAA", [(3, 2, "1"), (2, 1, "1"), (1, 3, "2"), (1, 0, "1"), (0, 1, "1"), (0, 2, "1")]),
        2: ("AAB", [(1, 0, "1"), (1, 2, "1"), (0, 2, "1"), (0, 2, "2")]),
    }
    v = spark.createDataFrame([(g, i, x) for g, (vs, _) in graphs.items() for i, x in enumerate(vs)], "gid long, vid int, vlb string")
    e = spark.createDataFrame([(g, i, *x) for g, (_, es) in graphs.items() for i, x in enumerate(es)], STAR)
    lies, places = {}, {}
    for g, (vs, es) in graphs.items():
        for n in range(1, len(es) + 1):
            for part in itertools.combinations(es, n):
                if connected(part):
                    form = directed_form(part, vs)
                    lies.setdefault(form, set()).add(g)
                    places[form, g] = places.get((form, g), 0) + 1
    want = {c: len(gs) for c, gs in lies.items() if len(gs) >= 2}
    patterns, found = mining.mine_frequent(v, e, MiningConfig(2, directed=True))
    got = {}
    for r in patterns.collect():
        steps = [s.split(",") for s in r.code.split(";")]
        labels = {int(i): x for s in steps for i, x in ((s[0], s[2]), (s[1], s[4]))}
        got[directed_form([(int(s[0]), int(s[1]), s[3]) for s in steps], labels)] = r.support
    assert got == want
    arcs = {(g, *x) for g, (_, es) in graphs.items() for x in es}
    for r in found.collect():
        for s in (s.split(",") for s in r.code.split(";")):
            assert (r.gid, r.vids[int(s[0])], r.vids[int(s[1])], s[3]) in arcs and graphs[r.gid][0][r.vids[int(s[0])]] == s[2]


def brute_rings(edges):
    """Shortest cycles through each edge, over all simple paths."""
    out = set()
    for i, (a, b) in enumerate(edges):
        paths, found = [(a,)], []
        while paths and not found:
            longer = []
            for p in paths:
                for j, (x, y) in enumerate(edges):
                    for s, t in ((x, y), (y, x)):
                        if j != i and s == p[-1] and t not in p:
                            longer.append((*p, t))
            paths = longer
            found = [p for p in paths if p[-1] == b]
        out |= {tuple(sorted(p)) for p in found}
    return out


def test_rings_of_any_length_and_in_dense_graphs(spark):
    graphs = {0: [(i, (i + 1) % 40) for i in range(40)], 1: [(i, j) for i in range(9) for j in range(i)], 2: [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (4, 2), (5, 6)], 3: [(i, (i + 1) % 14) for i in range(14)] + [(0, 7)], 4: [(0, 1), (1, 2)]}
    e = spark.createDataFrame([(g, i, min(x), max(x), "1") for g, es in graphs.items() for i, x in enumerate(es)], STAR)
    got = {}
    for r in rings.rings(e).collect():
        got.setdefault(r.gid, set()).add(tuple(r.ring))
    for g, es in graphs.items():
        assert got.get(g, set()) == brute_rings(es), g
    assert rings.rings(e.limit(0)).count() == 0


def test_several_files_of_graph_text(spark, tmp_path):
    one = "t # 5\nv 0 A\nv 1 B\ne 0 1 x\n"
    many = "".join(f"t # {i}\nv 0 C{i}\n" for i in range(51))
    (tmp_path / "a.txt").write_text(one)
    (tmp_path / "b.txt").write_text(many + "t # -1\nv 9 none\n")
    (tmp_path / "c.txt").write_text("t # 1\nv 0 last\n")
    v, _ = text.read_graph_text(spark, str(tmp_path))
    got = sorted((r.gid, r.vid, r.vlb) for r in v.collect())
    assert got == [(0, 0, "A"), (0, 1, "B"), *((i + 1, 0, f"C{i}") for i in range(51)), (52, 0, "last")]


def test_similar_pairs_and_classes_give_all_links(spark):
    sets = {1: "abcd", 2: "abcd", 3: "abce", 4: "xy", 5: "xy", 6: "abce"}
    fp = spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "gid long, id string")
    of = {r.gid: r["class"] for r in fingerprint.similar_classes(fp).collect()}
    pairs = {(r.a, r.b) for r in fingerprint.similar_pairs(fp, 0.6).collect()}
    got = {(a, b) for a in sets for b in sets if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in pairs)}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a], *sets[b]})}
    assert got == want


def test_featurize_file_and_feature_tables(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # 0\nv 0 A\nv 1 B\ne 0 1 x\nt # 1\nv 0 A\nt # -1\n")
    words = [(hashlib.md5(b"A").hexdigest(), [1.0, 0.0]), (hashlib.md5(b"B").hexdigest(), [0.0, 2.0]), ("UNK", [10.0, 10.0])]
    table = spark.createDataFrame(words, "token string, vector array<double>")
    vectors.featurize_file(spark, str(tmp_path / "g.txt"), str(tmp_path / "out"), table, radius=1, prefix="f")
    got = {r.gid: (r.f000, r.f001) for r in spark.read.option("header", True).schema("gid long, f000 double, f001 double").csv(str(tmp_path / "out")).collect()}
    # of the two identifiers around the one edge only the first stays; a lone vertex has none but its label
    assert got == {0: (11.0, 12.0), 1: (1.0, 0.0)}
    left, right = spark.createDataFrame([(1, 2.0)], "gid long, a double"), spark.createDataFrame([(1, 3.0), (2, 4.0)], "gid long, b double")
    assert sorted(map(tuple, mining.hstack(left, right).collect())) == [(1, 2.0, 3.0), (2, None, 4.0)]
    rows = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "gid long, name string")
    assert sorted(map(tuple, vectors.join_features(tables.drop_invalid(rows, "gid"), right).select("gid", "b").collect())) == [(1, 3.0), (3, None)]


def test_pattern_vectors_count_every_pattern(spark):
    v = spark.createDataFrame([(g, i, x) for g in (0, 1) for i, x in enumerate("ABA")], "gid long, vid int, vlb string")
    e = spark.createDataFrame([(0, 0, 0, 1, "1"), (0, 1, 1, 2, "1"), (1, 0, 0, 1, "1")], STAR)
    patterns, places = mining.mine_frequent(v, e, MiningConfig(1))
    codes = sorted(r.code for r in patterns.collect())
    got = {r.gid: dict(zip(r.at, r.n, strict=True)) for r in mining.pattern_vectors(mining.occurrences(places), patterns).collect()}
    assert [codes[i] for i in got[1]] == ["0,1,A,1,B"] and got[0][codes.index("0,1,A,1,B")] == 2 and len(got[0]) == len(codes) == 2


def test_joins_on_hot_keys_and_numbers(spark):
    rows = spark.range(20_000).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS long) AS k")
    values = storage.save(rows.groupBy("k").count().selectExpr("k", "k * 2 AS twice", "count AS n").filter("k <> 5"))
    got = storage.join_hot(rows, values, ["k"], "n")
    assert got.columns == ["k", "id", "twice", "n"] and got.count() == rows.filter("k <> 5").count() and got.filter("twice <> 2 * k").count() == 0
    assert storage.join_hot(rows.limit(0), values.limit(0), ["k"], "n").count() == 0
    n = storage.numbered(rows.select("id").orderBy("id", ascending=False), "id")
    assert n.filter("number <> id").count() == 0 and n.count() == 20_000


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

        set = dict.__setitem__

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_dir(Session("spark://host:7077"))
    assert storage.scratch_dir(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y/graphset"
    assert storage.scratch_dir(Session("local[4]")).startswith("file:///")
