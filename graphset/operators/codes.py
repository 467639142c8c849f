"""DFS codes of small labelled graphs: the minimal code, and canonical codes of arbitrary small graphs.

A code is a list of steps (from, to, label of from, edge label, label of to) over vertices numbered by discovery.  Steps
compare as depth-first growth does: a step back comes before a step forward; steps back by their target; steps forward from
the deepest vertex first; then by labels, null before all others.

Codes are written as text, fields separated by ``,`` and steps by ``;``.  Labels may be any text or null: ``%``, ``,``, ``;``
and ``|`` are written as ``%25``, ``%2C``, ``%3B`` and ``%7C``, null as ``%00``.  While patterns grow, labels are numbers in
the order of the labels, and codes over numbers are called keys.  In those of directed graphs the label of a step along an arc
begins with ``>``, that of a step against one with ``<``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.storage import join_hot, save

#: A label is a string, null, or in a key a number, with the direction before it in directed graphs.
Label = str | int | tuple | None
Step = tuple[int, int, Label, Label, Label]

NULL = "%00"
_ESCAPES = [("%", "%25"), (",", "%2C"), (";", "%3B"), ("|", "%7C")]


def escape(label: str | None) -> str:
    if label is None:
        return NULL
    for plain, written in _ESCAPES:
        label = label.replace(plain, written)
    return label


def unescape(field: str) -> str | None:
    if field == NULL:
        return None
    for plain, written in reversed(_ESCAPES):
        field = field.replace(written, plain)
    return field


def escaped(label: Column) -> Column:
    for plain, written in _ESCAPES:
        label = F.replace(label, F.lit(plain), F.lit(written))
    return F.coalesce(label, F.lit(NULL))


def unescaped(field: Column) -> Column:
    out = field
    for plain, written in reversed(_ESCAPES):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.when(field != NULL, out)


def parse(code: str) -> list[Step]:
    out = []
    for s in code.split(";") if code else []:
        a, b, *labels = s.split(",")
        out.append((int(a), int(b), *map(unescape, labels)))
    return out


def parse_key(key: str) -> list[Step]:
    out = []
    for s in key.split(";"):
        a, b, x, y, z = s.split(",")
        out.append((int(a), int(b), int(x), (y[0], int(y[1:])) if y[0] in "<>" else int(y), int(z)))
    return out


def text(steps: list[Step]) -> str:
    return ";".join(",".join([str(a), str(b), *map(escape, labels)]) for a, b, *labels in steps)


def _ordered(label: str | None) -> tuple[bool, str]:
    """Labels that compare, null first."""
    return label is not None, label or ""


def _plain(label: tuple[bool, str]) -> str | None:
    return label[1] if label[0] else None


def rightmost_path(steps: list[Step]) -> list[int]:
    """Vertices from the root to the one found last."""
    parent = {b: a for a, b, *_ in steps if b > a}
    path = [max(max(a, b) for a, b, *_ in steps)]
    while path[-1] in parent:
        path.append(parent[path[-1]])
    return path[::-1]


def extensions(key: str, directed: bool = False) -> list[tuple[int, int | None]]:
    """Where a pattern may grow: (from, to) back from the last vertex, (from, None) forward from the rightmost path.

    Two vertices may have several arcs, but one undirected edge.
    """
    path = rightmost_path(parse_key(key))
    return [(path[-1], q) for q in path[: -1 if directed else -2]] + [(p, None) for p in path]


def turned(label: tuple[str, int]) -> tuple[str, int]:
    """The label of a directed step, read the other way."""
    return {">": "<", "<": ">"}[label[0]], label[1]


def least_steps(labels: dict[int, Label], edges: list[tuple[int, int, Label]], directed: bool = False) -> Iterator[Step]:
    """The steps of the least code of a connected graph with at least one edge, one by one.

    Of the places that the code so far has, only those that take the least next step are kept: the one back to the vertex nearest
    to the root, else the one forward from the deepest vertex that has any, each with the least labels.
    """
    around: dict[int, list[tuple[int, int, Label]]] = {v: [] for v in labels}
    for i, (u, v, lab) in enumerate(edges):
        around[u].append((v, 1 << i, lab))
        around[v].append((u, 1 << i, turned(lab) if directed else lab))
    starts = [(labels[u], lab, labels[v], u, v, i) for u in labels for v, i, lab in around[u]]
    best = min(s[:3] for s in starts)
    yield (0, 1, *best)
    # vertices in the order of discovery, and the edges used, as bits
    maps = [((u, v), i) for x, y, z, u, v, i in starts if (x, y, z) == best]
    path, n = [0, 1], 2
    for _ in range(len(edges) - 1):
        last, before, found, least = path[-1], path[:-1], [], None
        for vs, used in maps:
            for w, i, lab in around[vs[last]]:
                if not i & used and w in vs and (q := vs.index(w)) in before:
                    rank = (q, lab)
                    if least is None or rank < least:
                        least, found = rank, []
                    if rank == least:
                        found.append((vs, used | i))
        if found:
            q, lab = least
            step = (last, q, labels[found[0][0][last]], lab, labels[found[0][0][q]])
        else:
            for p in reversed(path):
                for vs, used in maps:
                    for w, i, lab in around[vs[p]]:
                        if not i & used and w not in vs:
                            rank = (lab, labels[w])
                            if least is None or rank < least:
                                least, found = rank, []
                            if rank == least:
                                found.append(((*vs, w), used | i))
                if found:
                    break
            step = (p, n, labels[found[0][0][p]], *least)
            path = [*path[: path.index(p) + 1], n]
            n += 1
        maps = list(dict.fromkeys(found))
        yield step


def minimal(labels: dict[int, Label], edges: list[tuple[int, int, Label]], directed: bool = False) -> list[Step]:
    """The least code of a connected graph with at least one edge."""
    return list(least_steps(labels, edges, directed))


def graph_of(steps: str | list[Step]) -> tuple[dict[int, Label], list[tuple[int, int, Label]]]:
    labels: dict[int, Label] = {}
    edges = []
    for a, b, x, y, z in parse(steps) if isinstance(steps, str) else steps:
        labels.setdefault(a, x)
        labels.setdefault(b, z)
        edges.append((a, b, y))
    return labels, edges


def is_min_key(key: str, directed: bool = False) -> bool:
    steps = parse_key(key)
    # most that are not differ early
    return all(a == b for a, b in zip(steps, least_steps(*graph_of(steps), directed), strict=True))


def is_min_code(code: str) -> bool:
    """Of an undirected code over labels."""
    steps = [(a, b, *map(_ordered, labels)) for a, b, *labels in parse(code)]
    return steps == minimal(*graph_of(steps))


def arcs_of(code: str) -> tuple[str, list[int]]:
    """A directed code as its arcs, each from its tail, vertices numbered as they are first named; and of which vertex of the
    code each number is."""
    order: list[int] = []
    out = []
    for s in code.split(";"):
        a, b, x, y, z = s.split(",")
        if y[0] == "<":
            a, b, x, z = b, a, z, x
        for v in (int(a), int(b)):
            if v not in order:
                order.append(v)
        out.append(f"{order.index(int(a))},{order.index(int(b))},{x},{y[1:]},{z}")
    return ";".join(out), order


def canonical(labels: dict[int, str | None], edges: list[tuple[int, int, str | None]]) -> str:
    """The same text for isomorphic graphs, connected or not; lone vertices are written as their label."""
    seen: set[int] = set()
    parts = []
    # labels as numbers in their order, which compare faster
    names, kinds = (sorted({_ordered(x) for x in of}) for of in (labels.values(), (y for *_, y in edges)))
    name, kind = ({x: i for i, x in enumerate(of)} for of in (names, kinds))
    near: dict[int, set[int]] = {v: set() for v in labels}
    for u, v, _ in edges:
        near[u].add(v)
        near[v].add(u)
    for v in sorted(labels):
        if v not in seen:
            piece, todo = {v}, [v]
            while todo:
                for w in near[todo.pop()] - piece:
                    piece.add(w)
                    todo.append(w)
            seen |= piece
            own = [(a, b, kind[_ordered(y)]) for a, b, y in edges if a in piece]
            steps = minimal({x: name[_ordered(labels[x])] for x in piece}, own) if own else []
            parts.append(text([(a, b, *map(_plain, (names[x], kinds[y], names[z]))) for a, b, x, y, z in steps]) if own else escape(labels[v]))
    return "|".join(sorted(parts))


def is_min_key_udf(directed: bool = False):
    @F.pandas_udf(T.BooleanType())
    def minimal_ones(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: is_min_key(k, directed))

    return minimal_ones


def extensions_udf(directed: bool = False):
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType())])))
    def growing_points(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [{"p": p, "q": q} for p, q in extensions(k, directed)])

    return growing_points


@F.pandas_udf(T.StructType([T.StructField("arcs", T.StringType()), T.StructField("order", T.ArrayType(T.IntegerType()))]))
def arcs_of_udf(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([arcs_of(c) for c in codes], columns=["arcs", "order"])


@F.pandas_udf(T.StringType())
def _canonical_udf(vids: pd.Series, vlbs: pd.Series, srcs: pd.Series, dsts: pd.Series, elbs: pd.Series) -> pd.Series:
    rows = zip(vids, vlbs, srcs, dsts, elbs, strict=True)
    return pd.Series([canonical(dict(zip(v, x, strict=True)), list(zip(a, b, y, strict=True))) for v, x, a, b, y in rows], dtype=object)


def shapes(v: DataFrame, e: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with shape: the graph (vertices vid, vlb; edges src, dst, elb) of each key as one value, to be told apart by."""
    vs = v.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vid", "vlb"))).alias("vs"))
    es = e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "elb"))).alias("es"))
    none = F.array().cast(es.schema["es"].dataType)
    return vs.join(es, [*keys], "left").select(*keys, F.struct("vs", F.coalesce("es", none).alias("es")).alias("shape"))


def with_codes(shaped: DataFrame) -> DataFrame:
    """``shaped`` with the canonical code of its shape in its place; codes are worked out once per distinct shape, and met by the
    shape's digest, so that no shape goes to all executors or through the driver."""
    parts = ["vs.vid", "vs.vlb", "es.src", "es.dst", "es.elb"]
    keyed = save(shaped.withColumn("key", F.unhex(F.sha2(F.to_json("shape"), 256))))
    one = keyed.groupBy("key").agg(F.first("shape").alias("shape"), F.count("*").alias("n"))
    codes = save(one.select("key", "n", _canonical_udf(*(F.col(f"shape.{p}") for p in parts)).alias("code")))
    return join_hot(keyed.drop("shape"), codes.hint("merge"), ["key"], "n").drop("key", "n")
