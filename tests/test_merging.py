"""Candidates are rows of their own, made where their pair lies, and worked on once for pairs that are alike."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphset.operators import assemble


@pytest.fixture(scope="module")
def odd(spark):
    """Parallel bonds, a loop, a label without a cap, a null label, a lone vertex; ids from 3 on in graph 2."""
    v = spark.createDataFrame([(1, 0, "C"), (1, 1, "X"), (1, 2, None), (2, 3, "C"), (2, 5, "O"), (3, 0, "O")], "gid long, vid int, vlb string")
    e = spark.createDataFrame([(1, 0, 0, 1, "1"), (1, 1, 1, 0, "1"), (1, 2, 0, 0, "0.5"), (1, 3, 1, 2, "1"), (2, 0, 3, 5, "1")], "gid long, eid int, src int, dst int, elb string")
    caps = spark.createDataFrame([("C", 6), ("O", 3)], "vlb string, cap int")
    return v, e, caps


def test_merged_rows(spark, odd):
    v, e, caps = odd
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "base long, block long")
    got = {r.cand: r for r in assemble.node_merges(*assemble.both_packed(v, e, v, e, caps), pairs, "vs", "es").collect()}
    assert set(got) == {"n/1/2/0/3/u", "n/1/2/0/5/u", "n/1/2/0/5/w", "n/2/3/3/0/u", "n/2/3/3/0/w", "n/2/3/5/0/u"}
    r = got["n/1/2/0/5/w"]
    assert sorted(map(tuple, r.vs)) == [(1, "X"), (2, None), (6, "C"), (8, "O")]
    assert sorted(map(tuple, r.es)) == [(1, 2, "1.0"), (1, 8, "2.0"), (6, 8, "1.0")]


def test_candidates_are_not_shuffled(spark, odd):
    v, e, caps = odd
    pairs = spark.createDataFrame([(1, 2)], "base long, block long")
    _, nv, _ = assemble.merge_nodes(v, e, v, e, pairs, caps)
    plan = nv._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan[: plan.index("MapInArrow")]


def test_sanitize_works_on_pairs_that_are_alike_once(spark):
    v = spark.range(6).selectExpr("id AS gid", "explode(sequence(0, 1)) AS vid").withColumn("vlb", F.when((F.col("gid") == 5) & (F.col("vid") == 1), "O").otherwise("C"))
    e = spark.range(6).selectExpr("id AS gid", "0 AS eid", "0 AS src", "1 AS dst", "'1' AS elb")
    caps = spark.createDataFrame([("C", 4), ("O", 2)], "vlb string, cap int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 5), (4, 0)], "base long, block long")
    cands, nv, ne = assemble.merge_nodes(v, e, v, e, pairs, caps)
    want = [(r.base, r.code, r.cand) for r in assemble.sanitize(cands, nv, ne, caps).collect()]
    assert want and [(r.base, r.code, r.cand) for r in assemble.sanitized_nodes(v, e, v, e, pairs, caps).collect()] == want


@pytest.fixture(scope="module")
def crowded(spark, odd):
    """``odd``, and rings of four with and without a chord, of which many merges pass the caps."""
    rings = [(g, "CONC"[i] if g % 2 else "CCOO"[i], i) for g in range(10, 18) for i in range(4)]
    bonds = [(g, k, a, b, str(1 + (g + k) % 2)) for g in range(10, 18) for k, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)][: 4 + (g % 3 == 0)])]
    v = odd[0].unionByName(spark.createDataFrame([(g, i, x) for g, x, i in rings], "gid long, vid int, vlb string"))
    e = odd[1].unionByName(spark.createDataFrame(bonds, odd[1].schema))
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, *range(10, 18)) for b in (1, 2, 3, *range(10, 18))], "base long, block long")
    return v, e, spark.createDataFrame([("C", 5), ("O", 6)], "vlb string, cap int"), pairs


def test_candidates_above_a_cap_are_not_made(crowded):
    v, e, caps, pairs = crowded
    packed, sites = assemble.both_packed(v, e, v, e, caps), assemble.both_ring_sites(v, e, v, e, caps)
    for rows in (lambda **how: assemble.node_merges(*packed, pairs, "vs", "es", **how), lambda **how: assemble.edge_merges(*packed, *sites, pairs, "vs", "es", **how)):
        _, nv, ne = assemble.exploded(rows())
        bad = assemble.valence(nv.withColumnRenamed("cand", "gid"), ne.withColumnRenamed("cand", "gid"), caps).filter("iv < -1e-9")
        bad, made = {r.gid for r in bad.collect()}, {r.cand: (r.vs, r.es) for r in rows().collect()}
        want = {c: body for c, body in made.items() if c not in bad}
        assert bad and want and {r.cand: (r.vs, r.es) for r in rows(valid=True).collect()} == want
