"""Places of patterns, each once, and largest common parts, against brute force."""

from __future__ import annotations

import itertools
import random

import pytest

from graphset.operators import codes, matching, mining

EDGE = "gid long, eid int, src int, dst int, elb string"
PATTERNS = [
    "0,1,A,1,A",
    "0,1,A,1,B;1,2,B,1,A",
    "0,1,A,1,A;1,2,A,1,A;2,0,A,1,A",
    "0,1,A,1,A;0,2,A,1,A;0,3,A,1,A",
    "0,1,A,1,A;1,2,A,1,A;2,3,A,1,A;3,0,A,1,A",
    "0,1,A,1,B;1,2,B,%00,%2C",
    "0,1,A,1,A;1,2,A,1,A;2,0,A,1,A;2,3,A,1,B",
]


def places(labels, edges, vs, es):
    """Maps of the pattern's vertices into a graph that keep labels and edges."""
    have = {(a, b): x for a, b, x in es} | {(b, a): x for a, b, x in es}
    names = sorted(labels)
    out = []
    for image in itertools.permutations(vs, len(names)):
        at = dict(zip(names, image, strict=True))
        if all(vs[at[i]] == labels[i] for i in names) and all((at[a], at[b]) in have and have[at[a], at[b]] == x for a, b, x in edges):
            out.append(image)
    return out


def graphs(seed, n=25):
    rng = random.Random(seed)
    out = {}
    for g in range(n):
        vs = {i: rng.choice(["A", "A", "A", "B", ","]) for i in range(rng.randint(1, 6))}
        pairs = list(itertools.combinations(vs, 2))
        out[g] = (vs, [(a, b, rng.choice(["1", "1", "1", None])) for a, b in rng.sample(pairs, min(len(pairs), rng.randint(0, 9)))])
    return out


def tables(spark, sets):
    v = spark.createDataFrame([(g, i, x) for g, (vs, _) in sets.items() for i, x in vs.items()], "gid long, vid int, vlb string")
    return v, spark.createDataFrame([(g, i, *x) for g, (_, es) in sets.items() for i, x in enumerate(es)], EDGE)


@pytest.mark.parametrize("code", PATTERNS)
def test_each_symmetric_place_comes_once(spark, code):
    sets = graphs(4)
    v, e = tables(spark, sets)
    labels, edges = codes.graph_of(code)
    number, _ = matching.symmetry(labels, edges)
    assert number == len(places(labels, edges, labels, edges))
    got = [(r.gid, *r.vids) for r in matching.match_once(v, e, code).collect()]
    want = [(g, *p) for g, (vs, es) in sets.items() for p in places(labels, edges, vs, es)]
    assert len(got) == len(set(got)) and set(got) <= set(want) and number * len(got) == len(want)
    # every place is one of these, turned
    turns = places(labels, edges, labels, edges)
    assert {(g, *(p[i] for i in t)) for g, *p in got for t in turns} == set(want)
    assert mining.match_pattern(v, e, code).count() == len(want)


def test_symmetry_of_larger_patterns():
    star = {i: "A" for i in range(9)}
    assert matching.symmetry(star, [(0, i, "1") for i in range(1, 9)])[0] == 40_320
    ring = [(i, (i + 1) % 6, "1") for i in range(6)]
    assert matching.symmetry({i: "A" for i in range(6)}, ring)[0] == 12 and matching.symmetry({i: "A" for i in range(6)}, ring, directed=True)[0] == 6


@pytest.mark.parametrize("code", PATTERNS[2:])
def test_largest_common_parts_equal_brute_force(spark, code):
    sets = graphs(11, 18)
    labels, edges = codes.graph_of(code)
    want = {}
    for g, (vs, es) in sets.items():
        for n in range(len(labels), 0, -1):
            found = {}
            for part in itertools.combinations(sorted(labels), n):
                own = [x for x in edges if x[0] in part and x[1] in part]
                reach = {part[0]}
                for _ in part:
                    reach |= {y for a, b, _ in own for y in (a, b) if reach & {a, b}}
                if reach == set(part):
                    for image in places({x: labels[x] for x in part}, own, vs, es):
                        found.setdefault(tuple(sorted(image)), []).append(part)
            if found:
                want[g] = (n, set(found))
                break
    got = {}
    for r in matching.largest_common(*tables(spark, sets), code).collect():
        got.setdefault(r.gid, (r.size, set()))[1].add(tuple(sorted(x for x in r.vids if x is not None)))
        vs, es = sets[r.gid]
        have = {frozenset(x[:2]): x[2] for x in es}
        assert all(vs[y] == labels[x] for x, y in enumerate(r.vids) if y is not None)
        assert all(have[frozenset((r.vids[a], r.vids[b]))] == x for a, b, x in edges if r.vids[a] is not None and r.vids[b] is not None)
    assert got == want
