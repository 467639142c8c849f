"""Bridges, shortest cycles and smallest cycle bases of one small graph at a time.

A graph is a list of edges (a, b), numbered by their place; parallel edges are edges of their own and loops are not expected.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Edges = list[tuple[int, int]]


def _around(edges: Edges) -> dict[int, list[tuple[int, int]]]:
    around: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(edges):
        around.setdefault(a, []).append((b, i))
        around.setdefault(b, []).append((a, i))
    return around


def on_cycles(edges: Edges) -> list[int]:
    """The edges that are no bridges: depth first, an edge is a bridge if nothing below it reaches above it."""
    around = _around(edges)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges = set()
    for root in around:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(around[root]))]
        while stack:
            v, by, rest = stack[-1]
            for w, i in rest:
                if i == by:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, i, iter(around[w])))
                    break
            else:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[v])
                    if low[v] > order[above]:
                        bridges.add(by)
    return [i for i in range(len(edges)) if i not in bridges]


def shortest_cycles(edges: Edges) -> list[tuple[int, list[int]]]:
    """(edge, vertices in order of their numbers) of every shortest cycle through each edge."""
    kept = on_cycles(edges)
    around = _around([edges[i] for i in kept])
    out = []
    for k, i in enumerate(kept):
        a, b = edges[i]
        before: dict[int, set[int]] = {a: set()}
        front = [a]
        while b not in before:
            reached: dict[int, set[int]] = {}
            for v in front:
                for w, by in around[v]:
                    if by != k and w not in before:
                        reached.setdefault(w, set()).add(v)
            before |= reached
            front = list(reached)
        ways = [(b,)]
        while ways[0][-1] != a:
            ways = [(*way, v) for way in ways for v in before[way[-1]]]
        out += [(i, list(ring)) for ring in sorted({tuple(sorted(way)) for way in ways})]
    return out


def smallest_basis(edges: Edges) -> list[list[int]]:
    """The edges of each cycle of a basis of least total length; of equal ones the same in each run.

    Candidates are, for each vertex and edge, the edge with the shortest ways to its ends (Horton); weights tell all ways
    apart.  Of these, shorter ones first, each that is no sum of those before it is taken.
    """
    kept = on_cycles(edges)
    around = _around([edges[i] for i in kept])
    rank = len(kept) - len(around) + len(_pieces(around))
    if rank == 1:
        return [kept]
    one = 1 << len(kept)
    found = set()
    for root in around:
        way, todo, done = {root: 0}, [(0, root, 0)], {}
        while todo:
            _, v, bits = heapq.heappop(todo)
            if v in done:
                continue
            done[v] = bits
            for w, i in around[v]:
                longer = bits | 1 << i
                if w not in done and (w not in way or _weight(longer, one) < _weight(way[w], one)):
                    way[w] = longer
                    heapq.heappush(todo, (_weight(longer, one), w, longer))
        for i in range(len(kept)):
            a, b = edges[kept[i]]
            if a in done and not done[a] & done[b] and not (done[a] | done[b]) >> i & 1:
                found.add(done[a] | done[b] | 1 << i)
    basis: dict[int, int] = {}
    out = []
    for cycle in sorted(found, key=lambda c: _weight(c, one)):
        rest = cycle
        while rest and rest.bit_length() in basis:
            rest ^= basis[rest.bit_length()]
        if rest:
            basis[rest.bit_length()] = rest
            out.append([kept[i] for i in range(len(kept)) if cycle >> i & 1])
            if len(out) == rank:
                break
    return out


def _weight(bits: int, one: int) -> int:
    """Each edge weighs 1 and, far behind, a power of two of its own."""
    return bits.bit_count() * one + bits


def _pieces(around: dict[int, list[tuple[int, int]]]) -> list[set[int]]:
    out, seen = [], set()
    for root in around:
        if root not in seen:
            piece, todo = {root}, [root]
            while todo:
                for w, _ in around[todo.pop()]:
                    if w not in piece:
                        piece.add(w)
                        todo.append(w)
            seen |= piece
            out.append(piece)
    return out


def in_each_graph(packed: DataFrame, work: Callable[[Edges], list[tuple[list[int], list[int]]]]) -> DataFrame:
    """gid, eids, ring: ``work`` names edges by place and vertices, for each row (gid, eid, src, dst: arrays) of ``packed``."""
    eid, vid = packed.schema["eid"].dataType.elementType, packed.schema["src"].dataType.elementType
    fields = [packed.schema["gid"], T.StructField("eids", T.ArrayType(eid)), T.StructField("ring", T.ArrayType(vid))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = batch.column("eid"), np.concatenate([[0], np.cumsum([len(x) for x in batch.column("eid")])]).astype(int)
            flat = [batch.column(c).flatten().to_pylist() for c in ("src", "dst", "eid")]
            rows, eids, rings = [], [], []
            for g in range(len(ids)):
                own = slice(ends[g], ends[g + 1])
                for some, ring in work(list(zip(flat[0][own], flat[1][own], strict=True))):
                    rows.append(g)
                    eids.append([flat[2][ends[g] + i] for i in some])
                    rings.append(ring)
            gid = batch.column("gid").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([gid, pa.array(eids, batch.column("eid").type), pa.array(rings, batch.column("src").type)], names=["gid", "eids", "ring"])

    return packed.select("gid", "eid", "src", "dst").mapInArrow(run, T.StructType(fields))


def packed_edges(e: DataFrame, *more: str) -> DataFrame:
    """One row for each graph (and each value of ``more``): its edges as arrays, in the order of their ids."""
    rows = e.groupBy("gid", *more).agg(F.array_sort(F.collect_list(F.struct("eid", "src", "dst"))).alias("x"))
    return rows.select("gid", F.col("x.eid").alias("eid"), F.col("x.src").alias("src"), F.col("x.dst").alias("dst"))
