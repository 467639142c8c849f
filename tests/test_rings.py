"""Bridges, rings and cycle bases against brute force, in small graphs and, by the other way, as if they were large."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from graphset.operators import cycles, rings

EDGE = "gid long, eid int, src int, dst int, elb string"


def simple_cycles(edges):
    """Edge sets in which every vertex has two edges and which are connected."""
    out = []
    for n in range(2, len(edges) + 1):
        for part in itertools.combinations(range(len(edges)), n):
            ends = [v for i in part for v in edges[i]]
            if all(ends.count(v) == 2 for v in ends):
                reach, grew = {edges[part[0]][0]}, True
                while grew:
                    more = {v for i in part if reach & set(edges[i]) for v in edges[i]} - reach
                    reach |= more
                    grew = bool(more)
                if reach == set(ends):
                    out.append(part)
    return out


def random_graphs(n, seed, most=9):
    rng = random.Random(seed)
    out = {}
    for g in range(n):
        size = rng.randint(2, 7)
        pairs = [tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randint(1, most))]
        out[g] = pairs if g % 3 == 0 else sorted(set(pairs))
    return out


def table(spark, graphs):
    return spark.createDataFrame([(g, 10 + i, a, b, "1") for g, es in graphs.items() for i, (a, b) in enumerate(es)], EDGE)


def shortest(edges):
    out = set()
    all_ = simple_cycles(edges)
    for i in range(len(edges)):
        own = [c for c in all_ if i in c]
        out |= {(10 + i, tuple(sorted({v for k in c for v in edges[k]}))) for c in own if len(c) == min(map(len, own))}
    return out


@pytest.mark.parametrize("local", [1_000, 0])
def test_rings_and_bridges_equal_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(rings, "LOCAL_EDGES", local)
    graphs = random_graphs(40, 3)
    e = table(spark, graphs)
    got = {(r.gid, r.eid, tuple(r.ring)) for r in rings.edge_rings(e).collect()}
    assert got == {(g, *x) for g, es in graphs.items() for x in shortest(es)}
    on = {(g, 10 + i) for g, es in graphs.items() for c in simple_cycles(es) for i in c}
    assert {(r.gid, r.eid) for r in rings.ring_edges(e).collect()} == on
    assert {(r.gid, r.eid) for r in rings.bridge_edges(e).collect()} == {(g, 10 + i) for g, es in graphs.items() for i in range(len(es))} - on


@pytest.mark.parametrize("local", [1_000, 0])
def test_cycle_bases_are_smallest(spark, monkeypatch, local):
    monkeypatch.setattr(rings, "LOCAL_EDGES", local)
    graphs = random_graphs(30, 8) | {100: [(i, j) for i in range(5) for j in range(i)], 101: [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]}
    got = {}
    for r in rings.cycle_basis(table(spark, graphs)).collect():
        assert r.ring == sorted({v for i in r.eids for v in graphs[r.gid][i - 10]})
        got.setdefault(r.gid, []).append(tuple(i - 10 for i in r.eids))
    for g, es in graphs.items():
        basis, length = {}, 0
        for c in sorted(simple_cycles(es), key=len):
            rest = sum(1 << i for i in c)
            while rest and rest.bit_length() in basis:
                rest ^= basis[rest.bit_length()]
            if rest:
                basis[rest.bit_length()] = rest
                length += len(c)
        own = got.get(g, [])
        assert len(own) == len(set(own)) == len(basis) and sum(map(len, own)) == length and set(own) <= set(simple_cycles(es)), g


def test_long_paths_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(rings, "LOCAL_EDGES", 0)
    n = 300
    graphs = {0: [(i, i + 1) for i in range(n)], 1: [(i, i + 1) for i in range(n)] + [(n - 2, n)]}
    began = time.time()
    assert {(r.gid, tuple(r.ring)) for r in rings.rings(table(spark, graphs)).collect()} == {(1, (n - 2, n - 1, n))}
    assert time.time() - began < 120


def test_a_graph_of_a_thousand_edges_without_rings_or_with_one():
    path = [(i, i + 1) for i in range(1_000)]
    assert cycles.shortest_cycles(path) == [] and cycles.on_cycles([*path, (0, 1_000)]) == list(range(1_001))
    assert cycles.smallest_basis([*path, (0, 1_000)]) == [list(range(1_001))]
