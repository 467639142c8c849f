"""Steps that once moved more than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphset.operators import tables, vectors
from graphset.operators.alike import alike


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_vectors_are_made_where_sentences_lie(spark):
    tokens = spark.createDataFrame([(1, ["a", "a", None]), (2, ["z"]), (3, [])], "gid long, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.0])], "token string, vector array<double>")
    sums = vectors.sentence_vectors(tokens, vec)
    assert "strategy=broadcast" in plan(sums) and plan(sums).count("Join") == 1
    assert sorted(map(tuple, sums.collect())) == [(1, [2.0, 4.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]


def test_matrix_without_pivot(spark):
    e = spark.createDataFrame([(1, 0, 0, 1, "2"), (1, 1, 1, 2, None), (1, 2, 0, 1, "1")], "gid long, eid int, src int, dst int, elb string")
    m = tables.to_matrix(e, 2)
    assert "pivot" not in plan(m).lower()
    assert sorted(map(tuple, m.collect())) == [(1, 0, 0.0, 3.0), (1, 1, 3.0, 0.0), (1, 2, 0.0, 0.0)]


def test_written_tables_are_not_written_again(spark):
    v = spark.range(4).selectExpr("id AS gid", "0 AS vid", "'A' AS vlb")
    e = spark.createDataFrame([(3, 0, 0, 0, "1")], "gid long, eid int, src int, dst int, elb string")
    own, again = alike(v, e, written=True), alike(v, e)
    for some in (own, again):
        assert {(r.gid, r.weight) for r in some.sizes.collect()} == {(0, 3), (3, 1)}
        assert sorted(map(tuple, some.members.collect())) == [(0, 0), (1, 0), (2, 0), (3, 3)]
