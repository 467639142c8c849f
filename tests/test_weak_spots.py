"""Operators with two ways to the same rows, and rows that one common value must not multiply."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from graphset import storage
from graphset.operators import fingerprint, indices, rings, tables, vectors
from graphset.sources import text

EDGE = "gid long, eid int, src int, dst int, elb string"


def dijkstra(edges, start):
    around, best, todo = {}, {}, [(0.0, start)]
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    while todo:
        d, x = heapq.heappop(todo)
        if x not in best:
            best[x] = d
            for y, w in around.get(x, []):
                heapq.heappush(todo, (d + w, y))
    return {y: d for y, d in best.items() if y != start}


@pytest.mark.parametrize("local", [1_000, 0])
def test_distances_equal_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(rings, "LOCAL_EDGES", local)
    rng = random.Random(6)
    graphs = {g: [(*rng.sample(range(9), 2), float(rng.choice([1, 2, 3]))) for _ in range(rng.randint(1, 14))] for g in range(20)}
    graphs[50] = [(i, i + 1, 1.0) for i in range(40)]
    e = spark.createDataFrame([(g, i, a, b, str(w)) for g, es in graphs.items() for i, (a, b, w) in enumerate(es)] + [(77, 0, 3, 3, "1.0")], EDGE)
    v = e.select("gid", F.col("src").alias("vid"))
    for length, weigh in (("elb", True), (None, False)):
        got = {(r.gid, r.a, r.b): r.d for r in indices.shortest_paths(v, e, length).collect()}
        want = {}
        for g, es in graphs.items():
            own = [(a, b, w if weigh else 1.0) for a, b, w in es]
            want |= {(g, a, b): d for a in {x for t in own for x in t[:2]} for b, d in dijkstra(own, a).items()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_similar_pairs_with_an_identifier_in_every_graph(spark, threshold):
    rng = random.Random(2)
    sets = {g: {"hot", *rng.sample("abcdefgh", rng.randint(0, 5)), *([f"own{g}"] if g % 2 else [])} for g in range(60)}
    fp = spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "gid long, id string")
    first = {}
    for g in sorted(sets):
        first.setdefault(frozenset(sets[g]), g)
    want = {}
    for s, a in first.items():
        for t, b in first.items():
            if a < b and len(s & t) >= threshold * len(s | t) - 1e-9:
                want[a, b] = len(s & t) / len(s | t)
    assert {(r.a, r.b): r.similarity for r in fingerprint.similar_pairs(fp, threshold).collect()} == pytest.approx(want)


def test_sets_that_share_one_common_identifier_do_not_meet(spark):
    fp = spark.range(3_000).select(F.col("id").alias("gid"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("x"), F.col("id").cast("string")))).alias("id"))
    found = fingerprint.similar_pairs(fp.unionByName(spark.createDataFrame([(9_999, "hot")], "gid long, id string")), 0.5)
    assert found.count() == 3_000  # each with the set of the common one alone


def test_sets_meet_where_they_share_several_rare_identifiers(spark, monkeypatch):
    """Six labels at two places each: every set shares one or two rare identifiers with most others, and few sets are alike."""
    rng = random.Random(5)
    sets = {g: {f"{i}{rng.choice('abcdef')}" for i in range(rng.randint(6, 12))} for g in range(400)}
    fp = spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "gid long, id string")
    met, written = [], fingerprint.save

    def counted(df, *more):
        done = written(df, *more)
        if done.columns == ["a", "b"]:
            met.append(done.count())
        return done

    monkeypatch.setattr(fingerprint, "save", counted)
    few = {g: s for g, s in sets.items() if s not in [sets[h] for h in range(g)]}
    for threshold in (0.6, 0.75):
        found = {(r.a, r.b): r.similarity for r in fingerprint.similar_pairs(fp, threshold).collect()}
        assert found == pytest.approx({(a, b): len(few[a] & few[b]) / len(few[a] | few[b]) for a in few for b in few if a < b and len(few[a] & few[b]) >= threshold * len(few[a] | few[b]) - 1e-9})
    # of 79,800 pairs
    assert met[1] < 600


def test_weight_classes_are_the_pairs(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, None)], "gid long, w double")
    b = spark.createDataFrame([(7, 3.0), (8, 2.5), (8, 0.5), (9, 9.0)], "gid long, w double")
    rows = tables.weight_classes(a, b).collect()
    pairs = {(x.gid, y.gid) for x in rows for y in rows if x.side == "a" and y.side == "b" and x.total == y.total}
    assert pairs == {(r.gid_a, r.gid_b) for r in tables.same_weight(a, b).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}


def test_rare_words_become_unknown_by_either_way(spark, monkeypatch):
    rows = [(1, ["a", "b", None, "a"]), (2, []), (3, None), (4, ["a", "c", "a"])]
    tokens = spark.createDataFrame(rows, "gid long, tokens array<string>")
    want = [(1, ["a", "U", "U", "a"]), (4, ["a", "U", "a"])]
    assert sorted(map(tuple, vectors.insert_unk(tokens, 3, "U").collect())) == want
    monkeypatch.setattr(vectors, "is_small", lambda _: False)
    assert sorted(map(tuple, vectors.insert_unk(tokens, 3, "U").collect())) == want
    assert not storage.is_small(storage.save(tokens), max_rows=3)


def test_graph_text_is_read_as_arcs_or_edges(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # 0\nv 0 A\nv 1 B\ne 1 0 x\nt # -1\n")
    ends = [[(r.src, r.dst) for r in text.read_graph_text(spark, str(tmp_path / "g.txt"), directed=d)[1].collect()] for d in (False, True)]
    assert ends == [[(0, 1)], [(1, 0)]]


def test_unknown_words_are_the_same_by_every_way(spark, monkeypatch):
    """Sent whole, by a filter, by a filter that mistakes most words, and by a join with none, some or all words sent."""
    rng = random.Random(3)
    rows = [(g, [rng.choice(["hot", None, f"w{int(rng.paretovariate(0.7))}"]) for _ in range(rng.randrange(30))]) for g in [*range(200), 7, None]]
    tokens = spark.createDataFrame(rows, "gid long, tokens array<string>")
    found = lambda: sorted(((r.gid, r.tokens) for r in vectors.insert_unk(tokens, 3, "U").collect()), key=str)
    want = found()
    counts = {}
    for _, words in rows:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    assert want == sorted(((g, [w if counts[w] > 3 else "U" for w in words]) for g, words in rows if words), key=str)
    monkeypatch.setattr(vectors, "is_small", lambda done: done.columns == ["token"])
    out = vectors.insert_unk(tokens, 3, "U")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in out and "Aggregate" not in out
    assert found() == want
    monkeypatch.setattr(vectors, "FILTER_BITS", 1)
    assert found() == want
    monkeypatch.setattr(vectors, "FILTER_ROWS", 0)
    for sent in (0, 5, 500_000):
        monkeypatch.setattr(vectors, "BROADCAST_ROWS", sent)
        assert found() == want
        plan = vectors.insert_unk(tokens, 3, "U")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan
