"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; equal steps of the distance cut each pivot's vectors into
annuli, of which the number of vectors, the least and greatest distance and the greatest norm are kept.  For a query q, a
pivot p and an annulus with distances [a, b] and norms up to m, the triangle inequality bounds the inner product twice:

    q.v <= q.p + |q| b        and, as |q - v| >= max(a - |q - p|, |q - p| - b, 0) =: r,        q.v <= (|q|^2 + m^2 - r^2) / 2.

A query first expands the annuli with the highest bounds until they hold enough vectors; the k-th score so found is where it
stops: of the other annuli only those with a bound of at least that score are searched.  The result is exact whatever the
pivots are.  Pivots are fitted on ``sample`` vectors (a documented bound); all vectors are indexed.

How much that leaves depends on the vectors: in many dimensions distances to a pivot are all about alike, and then nearly all
annuli are searched (README has figures); the bounds save work where vectors lie in clusters.

Annuli are searched in blocks of about ``BLOCK`` vectors against chunks of about ``QUERIES`` queries of neighbouring pivots,
so neither a crowded annulus nor many queries make a large task.  The search is planned first, and only those blocks of the
index are shuffled that some query of a chunk has to see, once for each such chunk.

Defined cases: vectors that are null, empty, of a null id, or hold null or non-finite components take no part; vectors are
compared with those of their own length only, of which there may be ``LENGTHS`` (more are refused with an error, for the
driver keeps the bounds of each); rows that share an id are rows of their own, as candidates and as queries, and only the
query's own row is no candidate; ties go to the smaller id; fewer candidates than k give them all; scores beyond 64 bits are
cut to the nearest 64-bit value; an empty table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphset.llm.common import save

#: Vectors that pivots are fitted on, annuli of a pivot at most, vectors and queries of a search block, and lengths of vectors in
#: a table.
SAMPLE, RINGS, BLOCK, QUERIES, LENGTHS = 4096, 64, 4096, 4096, 64
#: Pivots at least and at most, and vectors for each pivot between these.
PIVOTS, MOST_PIVOTS, VECTORS_PER_PIVOT = 32, 256, 512


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds from evenly spread first ones."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(count, len(centres))).astype(int)]
    for _ in range(rounds):
        d = (sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)
        own = d.argmin(1)
        centres = np.stack([sample[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return q @ v.T
    return np.clip(q.astype(object) @ v.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


class Annuli:
    """Bounds of all annuli of one vector length."""

    def __init__(self, pivots: np.ndarray, rows: list[dict]):
        self.pivots = pivots
        self.cell = np.array([r["cell"] for r in rows], dtype=np.int64)
        self.pivot = self.cell // RINGS
        self.count = np.array([r["n"] for r in rows], dtype=np.int64)
        # a hair wider than measured, for the rounding of distances
        self.near = np.array([r["near"] for r in rows]) * (1 - 1e-9) - 1e-6
        self.far = np.array([r["far"] for r in rows]) * (1 + 1e-9) + 1e-6
        self.norm = np.array([r["norm"] for r in rows]) * (1 + 1e-9) + 1e-6

    def bounds(self, q: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(q, axis=1)
        gap = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ self.pivots.T + (self.pivots**2).sum(1), 0))[:, self.pivot]
        linear = (q @ self.pivots.T)[:, self.pivot] + size[:, None] * self.far
        slack = np.maximum(np.maximum(self.near - gap, gap - self.far) - 1e-6 * (1 + gap), 0)
        square = (size[:, None] ** 2 + self.norm**2 - slack**2) / 2
        b = np.minimum(linear, square)
        return b + 1e-9 * np.abs(b) + 1.0


def best_of(q: np.ndarray, qid: np.ndarray, least: np.ndarray, v: np.ndarray, vid: np.ndarray, names: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, name, score) of the best k vectors of a block for each query, but none below what the query has already."""
    out = []
    for at in range(0, len(q), 256):
        s = products(q[at : at + 256], v)
        for i in range(len(s)):
            ok = np.flatnonzero((vid != qid[at + i]) & (s[i] >= least[at + i]))
            if len(ok) > k:
                ok = ok[s[i, ok] >= np.partition(s[i, ok], len(ok) - k)[len(ok) - k]]
            ok = ok[np.lexsort((names[ok], -s[i, ok]))][:k]
            out.append((np.full(len(ok), qid[at + i]), names[ok], s[i, ok]))
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by ``every``."""
    wide = F.col(vector_col).cast("array<double>")
    whole = vectors.select(F.col(id_col).cast("long").alias("name"), wide.alias("x")).filter("name IS NOT NULL AND size(x) > 0 AND NOT exists(x, y -> y IS NULL OR isnan(y) OR abs(y) = double('infinity'))")
    # written once, so that a row keeps its number
    ints = save(whole.select("name", F.transform("x", lambda y: F.floor(y * F.lit(float(scale)))).alias("x"), F.monotonically_increasing_id().alias("id")))
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, ints.count() // VECTORS_PER_PIVOT))
    seen: dict[int, list] = {}
    for r in ints.orderBy(F.xxhash64("name"), "name", "id").limit(sample).collect():
        seen.setdefault(len(r["x"]), []).append(r["x"])
    centres = {d: fit_pivots(np.array(x, dtype=float), pivots) for d, x in seen.items()}
    widths = {d: max(float(np.median(np.sqrt(np.maximum(((np.array(x, dtype=float)[:, None, :8] - c[None, :, :8]) ** 2).sum(2).min(1), 0)))), 1.0) for d, x in seen.items() for c in [centres[d]]}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x = matrix(part.column(2), int(d)).astype(float)
                # a length that the sample lacks has one pivot, the origin
                c = centres.get(int(d), np.zeros((1, int(d))))
                gap = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
                p = gap.argmin(1)
                dist = np.linalg.norm(x - c[p], axis=1)
                ring = np.minimum(dist / widths.get(int(d), 1024.0) * 4, RINGS - 1).astype(np.int64)
                cols = [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(p), d, dtype=np.int32)), pa.array(p * RINGS + ring), pa.array(dist), pa.array(np.linalg.norm(x, axis=1))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "name", "x", "dim", "cell", "dist", "norm"])

    index = save(ints.select("id", "name", "x").mapInArrow(assign, "id long, name long, x array<long>, dim int, cell long, dist double, norm double"))
    lengths = [r[0] for r in index.select("dim").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    # at most LENGTHS * pivots * RINGS rows
    asks = F.count(F.when(F.col("name") % every == 0, 1))
    cells = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm").alias("norm"), asks.alias("asks")).orderBy("dim", "cell")
    by_dim: dict[int, list[dict]] = {}
    for r in cells.collect():
        by_dim.setdefault(r["dim"], []).append(r.asDict())
    annuli = {d: Annuli(centres.get(d, np.zeros((1, d))), rows) for d, rows in by_dim.items()}
    blocks = {(d, int(c)): max(1, -(-int(n) // BLOCK)) for d, a in annuli.items() for c, n in zip(a.cell, a.count, strict=True)}
    # queries are numbered pivot by pivot, about; QUERIES in a row are a chunk
    first_query: dict[tuple[int, int], tuple[int, int]] = {}
    count = 0
    for d, rows in by_dim.items():
        for r in rows:
            first_query[d, r["cell"]] = count, r["asks"]
            count += r["asks"]
    queries = index.filter(F.col("name") % every == 0)
    found_type = "query long, vec_id long, score long"
    plan_type = "dim int, cell long, block long, chunk long, id long, least double"

    def plan(first: bool):
        """The search blocks of each query: those of its first annuli, or the others that its k-th score leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(1).value_lengths().to_numpy()
                for d in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == d))
                    a = annuli[int(d)]
                    for at in range(0, len(part), 256):
                        piece = part.slice(at, 256)
                        b = a.bounds(matrix(piece.column(1), int(d)).astype(float))
                        order = np.argsort(-b, axis=1, kind="stable")
                        held = np.cumsum(a.count[order], axis=1)
                        # the first annuli: up to the one with which more than k vectors are held
                        early = np.zeros(b.shape, dtype=bool)
                        np.put_along_axis(early, order, held - a.count[order] <= k, axis=1)
                        floor = np.array([-np.inf if x is None else x for x in piece.column(2).to_pylist()])
                        take = early if first else ~early & (b >= floor[:, None])
                        row, cell = np.nonzero(take)
                        times = np.array([blocks[int(d), int(c)] for c in a.cell[cell]], dtype=np.int64)
                        at_row, at_cell = np.repeat(row, times), np.repeat(a.cell[cell], times)
                        block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, dtype=np.int64)
                        own = [first_query[int(d), c] for c in piece.column(3).to_pylist()]
                        chunk = np.array([(base + i % n) // QUERIES for (base, n), i in zip(own, piece.column(0).to_pylist(), strict=True)], dtype=np.int64)
                        rows = pa.array(at_row)
                        cols = [pa.array(np.full(len(at_row), d, dtype=np.int32)), pa.array(at_cell), pa.array(block), pa.array(chunk[at_row]), piece.column(0).take(rows), pa.array(floor[at_row])]
                        yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "block", "chunk", "id", "least"])

        return run

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block of each vector of the index."""
        for batch in batches:
            many = np.array([blocks[key] for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(batch.column(2).to_numpy() % np.maximum(many, 1))], names=["dim", "cell", "id", "name", "x", "block"])

    placed = index.select("dim", "cell", "id", "name", "x").mapInArrow(place, "dim int, cell long, id long, name long, x array<long>, block long")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of the index against one chunk of queries."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            d = left.column("dim")[0].as_py()
            q, v = matrix(left.column("x").combine_chunks(), d), matrix(right.column("x").combine_chunks(), d)
            out = best_of(q, left.column("id").to_numpy(), left.column("least").to_numpy(), v, right.column("id").to_numpy(), right.column("name").to_numpy(), k)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["query", "vec_id", "score"])

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        # ids only: the vectors of a chunk join them on their way to a block
        planned = save(asked.mapInArrow(plan(first), plan_type))
        keys = ["dim", "cell", "block"]
        # at most one row for each block and chunk
        met = planned.select(*keys, F.col("chunk").alias("of")).distinct()
        return planned.join(queries.select("id", "x"), "id").groupBy(*keys, "chunk").cogroup(placed.join(met, keys).groupBy(*keys, "of")).applyInArrow(search, found_type)

    early = save(visit(queries.select("id", "x", F.lit(None).cast("double").alias("least"), "cell"), True))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kth = early.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").cast("double").alias("least"))
    late = visit(queries.select("id", "x", "cell").join(kth, "id", "left").select("id", "x", "least", "cell"), False)
    best = early.unionByName(late).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    names = queries.select(F.col("id").alias("query"), F.col("name").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "vec_id", "score")
