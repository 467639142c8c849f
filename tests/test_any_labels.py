"""Patterns and canonical codes of graphs whose labels are null or hold the signs that codes are written with."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from graphset.operators import assemble, codes, mining, rings
from graphset.operators.mining import MiningConfig

LABELS = [None, "", ",", ";", "a b", "x/y", "k:v", "%", "%2C", "|", "<", ">1", "%00", "é,", "A"]
EDGE = "gid long, eid int, src int, dst int, elb string"


def graphs():
    """Three graphs that share most labels, numbered differently."""
    ring = [(0, 1, ";"), (1, 2, None), (2, 3, ","), (3, 0, "%00"), (0, 2, ">")]
    out = {}
    for g, shift in enumerate((0, 1, 2)):
        name = {i: (i + shift) % 4 for i in range(4)}
        labels = {name[0]: None, name[1]: ",", name[2]: ";x", name[3]: None}
        es = [(min(name[a], name[b]), max(name[a], name[b]), x) for a, b, x in (ring if g else ring[:-1])]
        out[g] = (labels, es)
    return out


def connected(edges):
    reach, rest = set(edges[0][:2]), list(edges[1:])
    while more := [e for e in rest if reach & set(e[:2])]:
        reach |= {x for e in more for x in e[:2]}
        rest = [e for e in rest if e not in more]
    return not rest


def tables(spark, sets):
    v = spark.createDataFrame([(g, i, x) for g, (vs, _) in sets.items() for i, x in vs.items()], "gid long, vid int, vlb string")
    e = spark.createDataFrame([(g, i, *x) for g, (_, es) in sets.items() for i, x in enumerate(es)], EDGE)
    return v, e


@pytest.mark.parametrize("in_row", [2_000, 0])
def test_mining_with_any_labels_equals_brute_force(spark, monkeypatch, in_row):
    monkeypatch.setattr(mining, "ARCS_IN_ROW", in_row)
    sets = graphs()
    lies = {}
    for g, (vs, es) in sets.items():
        for n in range(1, len(es) + 1):
            for part in itertools.combinations(es, n):
                if connected(part):
                    lies.setdefault(codes.canonical({x: vs[x] for p in part for x in p[:2]}, list(part)), set()).add(g)
    v, e = tables(spark, sets)
    patterns, places = mining.mine_frequent(v, e, MiningConfig(2, min_vertices=1))
    got = {r.code: r.support for r in patterns.filter("num_edge > 0").collect()}
    assert {codes.canonical(*codes.graph_of(c)): n for c, n in got.items()} == {c: len(gs) for c, gs in lies.items() if len(gs) >= 2}
    assert {codes.unescape(r.code): r.support for r in patterns.filter("num_edge = 0").collect()} == {None: 3, ",": 3, ";x": 3}
    assert all(codes.is_min_code(c) for c in got)
    # each place is one of the pattern's, and matching a code finds the same places
    found = {}
    for r in places.collect():
        labels, edges = codes.graph_of(r.code)
        vs, es = sets[r.gid]
        assert [vs[x] for x in r.vids] == [labels[i] for i in range(len(r.vids))]
        assert {es[i] for i in r.eids} == {(*sorted((r.vids[a], r.vids[b])), x) for a, b, x in edges}
        found.setdefault(r.code, set()).add((r.gid, *r.vids))
    longest = max(found, key=len)
    assert {(r.gid, *r.vids) for r in mining.match_pattern(v, e, longest).collect()} == found[longest]
    pv, pe = mining.code_to_graph(patterns.filter(F.col("code") == longest))
    labels, edges = codes.graph_of(longest)
    assert {r.vid: r.vlb for r in pv.collect()} == labels and [(r.src, r.dst, r.elb) for r in pe.orderBy("eid").collect()] == edges


def test_directed_mining_with_any_labels(spark):
    sets = {g: ({0: None, 1: ",", 2: None}, [(0, 1, "<"), (1, 2, ";"), (2, 0, None)][: 3 - g]) for g in (0, 1)}
    patterns, places = mining.mine_frequent(*tables(spark, sets), MiningConfig(2, directed=True))
    want = {"0,1,%00,<,%2C", "0,1,%2C,%3B,%00", "0,1,%2C,%3B,%00;2,0,%00,<,%2C"}
    assert {r.code for r in patterns.collect()} == want and places.count() == 6


def test_labels_come_back_from_codes(spark):
    assert [codes.unescape(codes.escape(x)) for x in LABELS] == LABELS
    steps = [(0, 1, x, y, z) for x, y, z in zip(LABELS, LABELS[1:], LABELS[2:], strict=False)]
    assert codes.parse(codes.text(steps)) == steps
    df = spark.createDataFrame([(x,) for x in LABELS], "x string").withColumn("e", codes.escaped(F.col("x"))).withColumn("u", codes.unescaped(F.col("e")))
    assert [(r.e, r.u) for r in df.collect()] == [(codes.escape(x), x) for x in LABELS]


def test_clique_labels_and_candidates_of_any_labels(spark):
    v, e = tables(spark, graphs())
    cl = rings.cliques(v, e)
    got = {(r.gid, r.cid): r.label for r in rings.clique_labels(v, e, cl).collect()}
    for r in cl.collect():
        vs, es = graphs()[r.gid]
        own = [x for x in es if x[0] in r.members and x[1] in r.members]
        assert got[r.gid, r.cid] == codes.canonical({m: vs[m] for m in r.members}, own)
    cands = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "cand string, base long")
    cv = spark.createDataFrame([(c, i, x) for c, names in (("a", ",;"), ("b", ";,"), ("c", ",,")) for i, x in enumerate(names)], "cand string, vid int, vlb string")
    ce = spark.createDataFrame([(c, 0, 1, "1.0") for c in "abc"], "cand string, src int, dst int, elb string")
    caps = spark.createDataFrame([(",", 4), (";", 4)], "vlb string, cap int")
    assert [(r.code, r.cand) for r in assemble.sanitize(cands, cv, ce, caps).collect()] == [("0,1,%2C,1.0,%2C", "c"), ("0,1,%2C,1.0,%3B", "a")]
