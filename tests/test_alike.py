"""Graphs that are alike are worked on once, and their written tables do not go through the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphset.operators import mining, rings
from graphset.operators.alike import alike, once
from graphset.operators.codes import is_min_key, with_codes
from graphset.operators.mining import MiningConfig


@pytest.fixture(scope="module")
def copies(spark):
    """Graphs 0 to 299: of every ten, eight are the same triangle, one has another label, one a null label and no edge."""
    kind = "CASE WHEN id % 10 < 8 THEN 'A' WHEN id % 10 = 8 THEN 'B' END"
    v = spark.range(300).selectExpr("id AS gid", "explode(sequence(0, 2)) AS vid", f"{kind} AS vlb")
    e = spark.range(300).filter("id % 10 < 9").selectExpr("id AS gid", "inline(from_json('[{\"eid\":0,\"src\":0,\"dst\":1,\"elb\":\"1\"},{\"eid\":1,\"src\":1,\"dst\":2,\"elb\":\"1\"},{\"eid\":2,\"src\":0,\"dst\":2,\"elb\":\"2\"}]', 'array<struct<eid:int,src:int,dst:int,elb:string>>'))")
    return v, e


def rows(df):
    return sorted(map(str, df.collect()))


def test_one_graph_of_each_class(copies):
    some = alike(*copies)
    assert {(r.gid, r.weight) for r in some.sizes.collect()} == {(0, 240), (8, 30), (9, 30)}
    assert some.v.count() == 9 and some.e.count() == 6 and some.members.count() == 300


def test_work_done_once_gives_every_graph_its_rows(copies):
    for work in (rings.cliques, rings.components):
        assert rows(once(*copies, work)) == rows(work(*copies))


def test_patterns_count_all_graphs(copies):
    patterns, places = mining.mine_frequent(*copies, MiningConfig(30, min_vertices=1))
    own = mining.occurrences(places).groupBy("code").agg(F.count("*").alias("support"), F.sum("n").alias("embeddings"))
    found = {(r.code, r.support, r.embeddings) for r in patterns.filter("num_edge > 0").collect()}
    assert found == {(r.code, r.support, r.embeddings) for r in own.collect()}
    assert {(r.code, r.support, r.embeddings) for r in patterns.filter("num_edge = 0").collect()} == {("A", 240, 720), ("B", 30, 90), ("%00", 30, 90)}
    assert {r.support for r in patterns.filter("num_edge = 3").collect()} == {240, 30}


def test_shapes_are_no_keys_of_joins(spark, copies):
    members = copies[0].groupBy("gid").agg(F.array_sort(F.collect_list("vid")).alias("members")).withColumn("cid", F.lit(0))
    coded = with_codes(rings.induced(*copies, members))
    assert "shape" not in coded._jdf.queryExecution().executedPlan().toString()
    assert coded.select("code").distinct().count() == 3


def test_keys_that_differ_early_are_told_early():
    # a star with twelve equal leaves has as many places of its code as there are orders of these
    assert not is_min_key(";".join(f"0,{i},1,0,{int(i < 13)}" for i in range(1, 14)))
    assert is_min_key("0,1,0,0,1;1,2,1,0,1") and not is_min_key("0,1,1,0,0;0,2,1,0,1")
