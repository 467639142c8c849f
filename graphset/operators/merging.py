"""Merged graphs of pairs of small graphs, made from batches of pairs and many candidates at a time.

A batch is taken apart into flat arrays; ``row`` says of which pair a site is, and each site names the vertices of the base and of
the block that become one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Vertices and bonds of the candidates that are held at once (one candidate, if it has more).
ELEMENTS = 200_000
#: Bonds that pass a cap by no more than this fit it.
TOLERANCE = 1e-9

VS = "vs array<struct<vid:int,vlb:string>>"
ES = "es array<struct<src:int,dst:int,elb:string>>"


@dataclass
class Ragged:
    """The lists of a batch: where each begins, how long it is, and the fields of all their elements."""

    start: np.ndarray
    length: np.ndarray
    fields: dict[str, pa.Array]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.fields[name].fill_null(np.nan if pa.types.is_floating(self.fields[name].type) else -1).to_numpy(zero_copy_only=False)


def ragged(column: pa.ListArray) -> Ragged:
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    kind = flat.type
    fields = {kind.field(i).name: x for i, x in enumerate(flat.flatten())}
    return Ragged(np.cumsum(length) - length, length, fields)


def spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): every place of each span, and of which span it is."""
    owner = np.repeat(np.arange(len(length)), length)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)


def numbers(*labels: pa.Array) -> list[np.ndarray]:
    """Labels as numbers, null as -1."""
    codes = pc.dictionary_encode(pa.concat_arrays(labels)).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(x) for x in labels])[:-1])


Sites = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def node_sites(batch: pa.RecordBatch) -> Sites:
    """(row, u, w, equal labels): free vertices whose bonds fit the larger cap together."""
    x, y = ragged(batch.column("vs")), ragged(batch.column("vs2"))
    rows = []
    for side in (x, y):
        owner, place = spans(side.start, side.length)
        free = side["tv"] - side["ev"] > 0
        rows.append((owner[free], place[free]))
    (at, i), (other, j) = rows
    n = np.bincount(other, minlength=len(batch))
    owner, place = spans((np.cumsum(n) - n)[at], n[at])
    i, j = i[owner], j[place]
    fit = x["ev"][i] + y["ev"][j] <= np.maximum(x["tv"][i], y["tv"][j])
    i, j, row = i[fit], j[fit], at[owner][fit]
    a, b = numbers(x.fields["vlb"], y.fields["vlb"])
    return row, x["vid"][i][:, None], y["vid"][j][:, None], (a[i] == b[j]) & (a[i] >= 0)


def edge_sites(batch: pa.RecordBatch) -> Sites:
    """(row, u, w, equal labels): every ring edge of the base with every one of the block, in both directions."""
    x, y = ragged(batch.column("xs")), ragged(batch.column("ys"))
    at, i = spans(x.start, x.length)
    owner, j = spans(y.start[at], y.length[at])
    i, row = i[owner], at[owner]
    la, lb, lc, ld = numbers(x.fields["la"], x.fields["lb"], y.fields["la"], y.fields["lb"])
    same = (np.minimum(la, lb)[i] == np.minimum(lc, ld)[j]) & (np.maximum(la, lb)[i] == np.maximum(lc, ld)[j])
    u = np.stack([x["a"][i], x["b"][i]], axis=1)
    c, d = y["a"][j], y["b"][j]
    ways = np.concatenate([np.stack([c, d], axis=1), np.stack([d, c], axis=1)])
    return np.tile(row, 2), np.tile(u, (2, 1)), ways, np.tile(same, 2)


def _lists(owner: np.ndarray, n: int, order: np.ndarray, **fields: pa.Array | np.ndarray) -> pa.ListArray:
    """One list of structs for each of ``n`` owners."""
    arrays = [x.take(pa.array(order)) if isinstance(x, pa.Array) else pa.array(x[order].astype(np.int32)) for x in fields.values()]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names=list(fields)))


def _body(batch: dict[str, Ragged], names: tuple[str, str], ends: tuple[str, ...], label: str, row: np.ndarray, by: np.ndarray, gone: np.ndarray, own: np.ndarray, other: np.ndarray) -> pa.ListArray:
    """Vertices (one end) or bonds (two) of the candidates: those of the base, then those of the block, behind it.  What lies in
    vertices that go goes; bonds that have one end there follow to those that stay."""
    owners, points, labels = [], [], []
    for side, name in enumerate(names):
        part = batch[name]
        owner, place = spans(part.start[row], part.length[row])
        at = np.stack([part[c][place] for c in ends]) + (by[row][owner] if side else 0)
        leaves = gone[owner] == side
        inside = np.ones(len(owner), dtype=bool)
        moved = at.copy()
        for k in range(len(ends)):
            hit = (own[owner] == at[k][:, None]) & leaves[:, None]
            inside &= hit.any(axis=1)
            moved[k] = np.where(hit.any(axis=1), (other[owner] * hit).sum(axis=1), at[k])
        owners.append(owner[~inside])
        points.append(moved[:, ~inside])
        labels.append(part.fields[label].take(pa.array(place[~inside])))
    owner, point = np.concatenate(owners), np.concatenate(points, axis=1)
    point.sort(axis=0)
    return _lists(owner, len(row), np.argsort(owner, kind="stable"), **dict(zip(ends, point, strict=True)), **{label: pa.concat_arrays(labels)})


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key in sorted ones, and whether it is there."""
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return place, keys[place] == wanted if len(keys) else np.zeros(wanted.shape, dtype=bool)


@dataclass
class _Bonds:
    """Of the graphs of a batch: a key and the bonds of each vertex, its cap, whether the bonds pass it, and how many do so in a graph;
    a key and the order of each bond."""

    keys: np.ndarray
    ev: np.ndarray
    tv: np.ndarray
    bad: np.ndarray
    n_bad: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, vs: str, es: str) -> _Bonds:
        x, y = ragged(batch.column(vs)), ragged(batch.column(es))
        owner, place = spans(x.start, x.length)
        # vertices and bonds of a graph are sorted
        keys = _key(owner, x["vid"][place])
        on, at = spans(y.start, y.length)
        weight = y.fields["elb"].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)[at]
        ends, there = zip(*(_at(keys, _key(on, y[c][at])) for c in ("src", "dst")), strict=True)
        ev = sum(np.bincount(e[t], weights=weight[t], minlength=len(keys)) for e, t in zip(ends, there, strict=True))
        tv = x["tv"][place].astype(float) if x.fields["tv"].null_count == 0 else x.fields["tv"].cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)[place]
        bad = tv - ev < -TOLERANCE
        both = there[0] & there[1]
        return _Bonds(keys, ev, tv, bad, np.bincount(owner[bad], minlength=len(batch)), (ends[0] * len(keys) + ends[1])[both], weight[both])

    def between(self, ends: np.ndarray) -> np.ndarray:
        """The orders of the bonds of pairs of places of vertices, 0 where there is none."""
        place, there = _at(self.pairs, ends.min(axis=1) * len(self.keys) + ends.max(axis=1))
        return np.where(there, self.weights[place], 0.0) if len(self.pairs) else np.zeros(len(ends))


def _key(owner: np.ndarray, vid: np.ndarray) -> np.ndarray:
    return (owner.astype(np.int64) << 32) + vid.astype(np.int64)


def _valid(batch: pa.RecordBatch, row: np.ndarray, u: np.ndarray, w: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which candidates have no vertex whose bonds pass the cap of its label: only those of the vertices that become one change, to the
    sum of both without the bond that goes."""
    x, y = _Bonds.of(batch, "vs", "es"), _Bonds.of(batch, "vs2", "es2")
    i, j = (_at(side.keys, _key(row[:, None], z))[0] for side, z in ((x, u), (y, w)))
    others = x.n_bad[row] - x.bad[i].sum(axis=1) + y.n_bad[row] - y.bad[j].sum(axis=1)
    gone = np.where(keep, y.between(j), x.between(i)) if u.shape[1] == 2 else np.zeros(len(row))
    room = np.where(keep[:, None], x.tv[i], y.tv[j]) - (x.ev[i] + y.ev[j] - gone[:, None])
    return (others == 0) & (room >= -TOLERANCE).all(axis=1)


def merges(sites: Callable[[pa.RecordBatch], Sites], kind: str, *bodies: str, valid: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of pairs (base, block, by, vs, es, vs2, es2 and what ``sites`` needs) as candidates: cand, base, block, u, w, keep,
    and the ``bodies`` (vs, es) that are asked for; with ``valid`` those alone that have no vertex above its cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, u, w, same = sites(batch)
            site = np.repeat(np.arange(len(row)), 2 - same)
            first = np.concatenate([[True], site[1:] != site[:-1]])[: len(site)]
            parts = {c: ragged(batch.column(c)) for c in ("vs", "es", "vs2", "es2") if c[:2] in bodies}
            by = batch.column("by").to_numpy().astype(np.int64)
            row, u, w = row[site], u[site].astype(np.int64), w[site].astype(np.int64)
            if valid and len(row):
                fit = _valid(batch, row, u, w, first)
                row, u, w, first = row[fit], u[fit], w[fit], first[fit]
            size = np.ones(len(row), dtype=np.int64) + sum(x.length[row] for x in parts.values())
            piece = (np.cumsum(size) - 1) // ELEMENTS
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(row)] if len(row) else []
            for lo, hi in zip(cuts, cuts[1:]):
                some = slice(lo, hi)
                r, x, y, keep = row[some], u[some], w[some], first[some]
                base, block = (batch.column(c).take(pa.array(r)) for c in ("base", "block"))
                survivor = pa.array(np.where(keep, "u", "w"))
                site_text = [pa.array(z).cast(pa.string()) for z in (*x.T, *y.T)]
                out = {"cand": pc.binary_join_element_wise(pa.scalar(kind), base.cast(pa.string()), block.cast(pa.string()), *site_text, survivor, "/"), "base": base, "block": block}
                behind = y + by[r][:, None]
                for name, z in (("u", x), ("w", behind)):
                    out[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel().astype(np.int32)))
                out["keep"] = survivor
                own, other, gone = np.where(keep[:, None], behind, x), np.where(keep[:, None], x, behind), keep.astype(int)
                if "vs" in bodies:
                    out["vs"] = _body(parts, ("vs", "vs2"), ("vid",), "vlb", r, by, gone, own, other)
                if "es" in bodies:
                    out["es"] = _body(parts, ("es", "es2"), ("src", "dst"), "elb", r, by, gone, own, other)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def schema(pairs: T.StructType, *bodies: str) -> T.StructType:
    more = T.StructType.fromDDL(", ".join(["u array<int>, w array<int>, keep string", *({"vs": VS, "es": ES}[b] for b in bodies)]))
    return T.StructType([T.StructField("cand", T.StringType()), pairs["base"], pairs["block"], *more.fields])
