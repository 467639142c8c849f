"""Scores and indices of vertices and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.operators.rings import by_size
from graphset.operators.tables import degrees, symmetrize
from graphset.storage import save, small


def fragment_score(fp: DataFrame, fscores: DataFrame, missing: float = -4.0) -> DataFrame:
    """gid, score: mean of the scores (fid, score) of a graph's fragments (gid, fid, n), weighted by n."""
    s = F.coalesce("score", F.lit(missing))
    return fp.join(small(fscores), "fid", "left").groupBy("gid").agg((F.sum(F.col("n") * s) / F.sum("n")).alias("score"))


def abc_index(v: DataFrame, e: DataFrame, z: str = "z") -> DataFrame:
    """gid, eid, index: sqrt((du + dv - 2) / (du dv)) + bond + (zu + zv) / 6, to 5 places; v has the number ``z``."""
    d = degrees(v, e).join(v.select("gid", "vid", F.col(z).alias("z")), ["gid", "vid"])
    on = e.join(d.withColumnsRenamed({"vid": "src", "degree": "du", "z": "zu"}), ["gid", "src"]).join(d.withColumnsRenamed({"vid": "dst", "degree": "dv", "z": "zv"}), ["gid", "dst"])
    x = F.sqrt((F.col("du") + F.col("dv") - 2) / (F.col("du") * F.col("dv"))) + F.col("elb").cast("double") + (F.col("zu") + F.col("zv")) / 6
    return on.select("gid", "eid", F.round(x, 5).alias("index"))


def distances(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """(a, b, d) of all reachable pairs of one graph: the matrix of distances, made shorter through one vertex after another."""
    names = sorted({v for x in edges for v in x[:2]})
    place = {v: i for i, v in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for a, b, w in edges:
        i, j = place[a], place[b]
        d[i, j] = d[j, i] = min(d[i, j], w)
    for k in range(len(names)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    rows, cols = np.nonzero(np.isfinite(d))
    return [(names[i], names[j], float(d[i, j])) for i, j in zip(rows.tolist(), cols.tolist(), strict=True) if i != j]


def local_paths(arcs: DataFrame) -> DataFrame:
    """``shortest_paths`` of graphs (gid, src, dst, d), many to a task."""
    packed = arcs.groupBy("gid").agg(F.collect_list(F.struct("src", "dst", "d")).alias("x")).select("gid", "x.src", "x.dst", "x.d")
    vid = arcs.schema["src"].dataType
    schema = T.StructType([arcs.schema["gid"], T.StructField("a", vid), T.StructField("b", vid), T.StructField("d", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            ends = np.concatenate([[0], np.cumsum([len(x) for x in batch.column(1)])]).astype(int)
            flat = list(zip(*(batch.column(k).flatten().to_pylist() for k in (1, 2, 3)), strict=True))
            for g in range(len(batch)):
                own = distances(flat[ends[g] : ends[g + 1]])
                rows += [g] * len(own)
                found += own
            a, b, d = zip(*found, strict=True) if found else ((), (), ())
            kind = batch.column(1).type.value_type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(a, kind), pa.array(b, kind), pa.array(d, pa.float64())], names=["gid", "a", "b", "d"])

    return packed.mapInArrow(run, schema)


def joined_paths(arcs: DataFrame) -> DataFrame:
    """``shortest_paths`` of large graphs (gid, src, dst, d: both ways).  Paths up to double in every round, and only pairs that
    the last round found or made shorter are joined to the others."""
    best = save(arcs.groupBy("gid", F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min("d").alias("d")))
    fresh = best
    while True:
        front = fresh.withColumnsRenamed({"b": "m", "d": "d1"}).join(best.withColumnsRenamed({"a": "m", "d": "d2"}), ["gid", "m"])
        back = best.withColumnsRenamed({"b": "m", "d": "d1"}).join(fresh.withColumnsRenamed({"a": "m", "d": "d2"}), ["gid", "m"])
        two = front.unionByName(back, allowMissingColumns=True).filter("a <> b").groupBy("gid", "a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
        known = best.select("gid", "a", "b", F.col("d").alias("old"))
        fresh = save(two.join(known, ["gid", "a", "b"], "left").filter("old IS NULL OR d < old - 1e-12").select("gid", "a", "b", "d"))
        if fresh.isEmpty():
            return best
        best = save(best.unionByName(fresh).groupBy("gid", "a", "b").agg(F.min("d").alias("d")))


def shortest_paths(v: DataFrame, e: DataFrame, length: str | None = None) -> DataFrame:
    """gid, a, b, d for all reachable pairs a <> b of each graph.

    Graphs of up to ``LOCAL_EDGES`` edges are worked on many to a task, larger ones by joins.
    """
    w = F.lit(1.0) if length is None else F.col(length).cast("double")
    few, many = by_size(e.withColumn("d", w).select("gid", "src", "dst", "d"))
    out = local_paths(few)
    return save(out if many is None else out.unionByName(joined_paths(symmetrize(many))))


def balaban_terms(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, eid, index: 1 / sqrt(s_u s_v) to 5 places; s sums a vertex's distances with edges 1 / order long."""
    weighted = e.withColumn("len", 1 / F.col("elb").cast("double"))
    s = shortest_paths(v, weighted, "len").groupBy("gid", F.col("a").alias("vid")).agg(F.sum("d").alias("s"))
    on = e.join(s.withColumnsRenamed({"vid": "src", "s": "su"}), ["gid", "src"]).join(s.withColumnsRenamed({"vid": "dst", "s": "sv"}), ["gid", "dst"])
    return on.select("gid", "eid", F.round(1 / F.sqrt(F.col("su") * F.col("sv")), 5).alias("index"))


def alpha_centrality(v: DataFrame, e: DataFrame, rounds: int = 40) -> DataFrame:
    """gid, vid, index: (I - A'/n)^-1 (deg / (n - 1)) / n^2 by its power series; the graph without weights."""
    n = v.groupBy("gid").agg(F.count("*").alias("n"))
    base = save(degrees(v, e).join(n, "gid").select("gid", "vid", "n", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("b")))
    arcs = save(symmetrize(e.select("gid", "src", "dst")))
    x = base.select("gid", "vid", F.col("b").alias("x"))
    for i in range(rounds):
        near = arcs.join(x.withColumnsRenamed({"vid": "dst"}), ["gid", "dst"]).groupBy("gid", F.col("src").alias("vid")).agg(F.sum("x").alias("s"))
        x = base.join(near, ["gid", "vid"], "left").select("gid", "vid", (F.col("b") + F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("x"))
        if i % 4 == 3:
            x = save(x)
    return base.join(x, ["gid", "vid"]).select("gid", "vid", (F.col("x") / F.pow("n", F.lit(2))).alias("index"))


def estate(v: DataFrame, e: DataFrame, intrinsic: str) -> DataFrame:
    """gid, vid, index: I_i plus the sum of (I_i - I_j) / (d_ij + 1)^2."""
    own = v.select("gid", "vid", F.col(intrinsic).cast("double").alias("i"))
    d = shortest_paths(v, e)
    pairs = d.join(own.withColumnsRenamed({"vid": "a", "i": "ia"}), ["gid", "a"]).join(own.withColumnsRenamed({"vid": "b", "i": "ib"}), ["gid", "b"])
    s = pairs.groupBy("gid", F.col("a").alias("vid")).agg(F.sum((F.col("ia") - F.col("ib")) / F.pow(F.col("d") + 1, F.lit(2))).alias("s"))
    return own.join(s, ["gid", "vid"], "left").select("gid", "vid", (F.col("i") + F.coalesce("s", F.lit(0.0))).alias("index"))


def node_score(v: DataFrame, e: DataFrame, method: str, intrinsic: str = "z") -> DataFrame:
    if method == "estate":
        return estate(v, e, intrinsic)
    if method == "alpha_centrality":
        return alpha_centrality(v, e)
    raise ValueError(f"no node score {method!r}")


def edge_score(v: DataFrame, e: DataFrame, method: str, z: str = "z") -> DataFrame:
    if method == "abc":
        return abc_index(v, e, z)
    if method == "balaban":
        return balaban_terms(v, e)
    raise ValueError(f"no edge score {method!r}")
