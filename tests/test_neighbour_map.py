"""Neighbours against brute force, and how many of them stay near on the map."""

from __future__ import annotations

import numpy as np

from graphset.operators import neighbour_map as nm
from graphset.operators.vectors import project_2d


def clusters(n=400, groups=12, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[np.arange(n) % groups] + 0.15 * rng.normal(size=(n, dim))


def true_neighbours(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [set(row[:k]) for row in np.argsort(d, axis=1, kind="stable")]


def kept(x, places, k):
    """Mean share of the k nearest vectors that are among the k nearest places."""
    return np.mean([len(a & b) / k for a, b in zip(true_neighbours(x, k), true_neighbours(places, k), strict=True)])


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vector array<double>")


def test_neighbours_equal_brute_force_where_cells_hold_all(spark, monkeypatch):
    x = clusters(300)
    monkeypatch.setattr(nm, "BLOCK", 64)
    want = true_neighbours(x, 5)
    got = {}
    for r in nm.nearest(frame(spark, x), 5).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert all(got[i] == want[i] for i in range(300))
    monkeypatch.setattr(nm, "VECTORS_PER_PIVOT", 20)
    some = {}
    for r in nm.nearest(frame(spark, x), 5).collect():
        some.setdefault(r.a, set()).add(r.b)
    assert np.mean([len(some[i] & want[i]) / 5 for i in range(300)]) >= 0.9


def test_neighbours_stay_near_on_the_map(spark):
    x = clusters()
    rows = frame(spark, x)
    place = {r.id: (r.x, r.y) for r in nm.neighbour_map(rows, k=8).collect()}
    again = {r.id: (r.x, r.y) for r in nm.neighbour_map(rows.repartition(3), k=8).collect()}
    flat = {r.id: (r.x, r.y) for r in project_2d(rows).collect()}
    y, z, p = (np.array([m[i] for i in range(len(x))]) for m in (place, again, flat))
    group = np.arange(len(x)) % 12
    same = np.mean([np.mean(group[list(s)] == group[i]) for i, s in enumerate(true_neighbours(y, 8))])
    assert same >= 0.9 and kept(x, y, 8) > kept(x, p, 8) and np.allclose(y, z, atol=1e-6)


def test_maps_of_few_rows(spark):
    assert nm.neighbour_map(frame(spark, np.zeros((0, 2))).select("id", "vector")).count() == 0
    one = nm.neighbour_map(spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, 1.0])], "id long, vector array<double>"), rounds=2).collect()
    assert {r.id for r in one} == {1, 3} and all(np.isfinite([r.x, r.y]).all() for r in one)
