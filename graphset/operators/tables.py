"""Basic operators over ``vertices(gid, vid, vlb)`` and ``edges(gid, eid, src, dst, elb)``.

Undirected edges are stored once with src < dst.  Labels are strings and compare by code point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.storage import numbered, small


def graphs_from_tables(df: DataFrame, gid: str, order: list[str], vlb: Column) -> DataFrame:
    """Vertices from rows: one graph per ``gid``, vertices numbered from 0 in ``order``."""
    w = Window.partitionBy(gid).orderBy(*order)
    return df.select(F.col(gid).alias("gid"), (F.row_number().over(w) - 1).alias("vid"), vlb.cast("string").alias("vlb"))


def number_edges(e: DataFrame) -> DataFrame:
    """Edges with ``eid`` from 0 in each graph, by (src, dst, elb)."""
    w = Window.partitionBy("gid").orderBy("src", "dst", "elb")
    return e.withColumn("eid", F.row_number().over(w) - 1).select("gid", "eid", "src", "dst", "elb")


def limit_graphs(df: DataFrame, n: int) -> DataFrame:
    """The rows of the first n graphs by ordinal."""
    return df.filter(F.col("gid") < n)


def normalize_graphs(v: DataFrame, e: DataFrame, vmap: DataFrame | None = None, emap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids of each graph shifted to start at 0; labels replaced through (label, name) tables, unknown ones kept."""
    low = v.groupBy("gid").agg(F.min("vid").alias("low"))

    def named(df: DataFrame, col: str, table: DataFrame | None) -> DataFrame:
        if table is None:
            return df
        t = small(table.select(F.col("label").alias(col), F.col("name")))
        return df.join(t, col, "left").withColumn(col, F.coalesce("name", col)).drop("name")

    nv = named(v.join(low, "gid").withColumn("vid", F.col("vid") - F.col("low")).drop("low"), "vlb", vmap)
    ne = named(e.join(low, "gid").withColumn("src", F.col("src") - F.col("low")).withColumn("dst", F.col("dst") - F.col("low")).drop("low"), "elb", emap)
    return nv.select(*v.columns), ne.select(*e.columns)


def dedup_vertices(v: DataFrame, pos: str) -> DataFrame:
    """The first label of a repeated vertex wins."""
    return v.groupBy("gid", "vid").agg(F.min_by("vlb", pos).alias("vlb"))


def dedup_edges(e: DataFrame, pos: str) -> DataFrame:
    """The last label of parallel edges wins."""
    return e.groupBy("gid", "src", "dst").agg(F.max_by("elb", pos).alias("elb"))


def symmetrize(e: DataFrame) -> DataFrame:
    """Both directions of each edge under one eid."""
    ways = (F.struct(*(F.col({"src": b, "dst": a}.get(c, c)).alias(c) for c in e.columns)) for a, b in (("dst", "src"), ("src", "dst")))
    return e.select(F.explode(F.array(*ways)).alias("way")).select("way.*")


def orient(e: DataFrame) -> DataFrame:
    """The smaller end first."""
    return e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def invert_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """A two-column map read the other way round."""
    return df.select(F.col(value).alias(key), F.col(key).alias(value))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def disjoint_union(v1: DataFrame, e1: DataFrame, v2: DataFrame, e2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each gid the graph of the first tables beside that of the second, whose ids are shifted behind."""
    size = v1.groupBy("gid").agg((F.max("vid") + 1).alias("by"))
    moved_v = v2.join(size, "gid", "left").withColumn("vid", F.col("vid") + F.coalesce("by", F.lit(0))).drop("by")
    moved_e = e2.join(size, "gid", "left")
    moved_e = moved_e.withColumns({c: F.col(c) + F.coalesce("by", F.lit(0)) for c in ("src", "dst")}).drop("by")
    return v1.unionByName(moved_v), e1.unionByName(moved_e)


def offset_ids(pieces: DataFrame) -> DataFrame:
    """(gid, piece, n) with the first id of each piece, running on by piece."""
    w = Window.partitionBy("gid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("first_id", F.coalesce(F.sum("n").over(w), F.lit(0)))


def relabel(v: DataFrame, e: DataFrame, pos: str = "vid") -> tuple[DataFrame, DataFrame]:
    """Vertices numbered densely from 0 in the order of ``pos``; edges follow."""
    new = v.withColumn("new_id", F.row_number().over(Window.partitionBy("gid").orderBy(pos)) - 1)
    ids = new.select("gid", "vid", "new_id")
    moved = e.join(ids.withColumnsRenamed({"vid": "src", "new_id": "s"}), ["gid", "src"]).join(ids.withColumnsRenamed({"vid": "dst", "new_id": "d"}), ["gid", "dst"])
    moved = moved.withColumns({"src": F.col("s"), "dst": F.col("d")}).select(*e.columns)
    return new.withColumn("vid", F.col("new_id")).select(*v.columns), moved


def distinct_labels(v: DataFrame) -> DataFrame:
    """gid, labels: distinct labels of each graph in the order they are first seen."""
    first = v.groupBy("gid", "vlb").agg(F.min("vid").alias("at"))
    return first.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vlb"))), lambda x: x["vlb"]).alias("labels"))


def label_dictionary(v: DataFrame) -> DataFrame:
    """vlb, label_id: labels numbered by first appearance over (gid, vid)."""
    first = v.groupBy("vlb").agg(F.min(F.struct("gid", "vid")).alias("first"))
    return numbered(first.select("vlb", "first.gid", "first.vid"), "gid", "vid", name="label_id").select("vlb", F.col("label_id").cast("int").alias("label_id"))


def encode_labels(v: DataFrame, dictionary: DataFrame) -> DataFrame:
    return v.join(small(dictionary), "vlb").select("gid", "vid", "label_id")


def decode_labels(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return coded.join(small(dictionary), "label_id").select("gid", "vid", "vlb")


def degrees(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, vid, degree (0 for a lone vertex)."""
    d = symmetrize(e.select("gid", "src", "dst")).groupBy("gid", F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    return v.select("gid", "vid").join(d, ["gid", "vid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def vertex_features(v: DataFrame, e: DataFrame, mode: str | Callable[[], Column] = "default", in_ring: DataFrame | None = None, caps: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """vlb replaced by a feature label: 'label' keeps it; 'default' joins with dots in-ring flag, label, degree, with ``caps``
    (vlb, cap) the sum of bond orders and what the cap leaves of it, and the columns of ``v`` that ``more`` names (numbers,
    charges, hydrogens); a function gives any column over gid, vid, vlb, degree, ring and ``more``.  Missing values are ``-``.
    """
    rich = v.join(degrees(v, e), ["gid", "vid"])
    if in_ring is None:
        rich = rich.withColumn("ring", F.lit(0))
    else:
        rich = rich.join(in_ring.select("gid", "vid").distinct().withColumn("r", F.lit(1)), ["gid", "vid"], "left").withColumn("ring", F.coalesce("r", F.lit(0)))
    parts = ["ring", "vlb", "degree"]
    if caps is not None:
        orders = symmetrize(e.select("gid", "src", "dst", "elb")).groupBy("gid", F.col("src").alias("vid")).agg(F.sum(F.col("elb").cast("double")).alias("ev"))
        rich = rich.join(orders, ["gid", "vid"], "left").join(small(caps.select("vlb", F.col("cap").cast("double").alias("tv"))), "vlb", "left").withColumn("ev", F.coalesce("ev", F.lit(0.0))).withColumn("iv", F.col("tv") - F.col("ev"))
        parts += ["ev", "iv"]
    if callable(mode):
        label = mode()
    elif mode == "label":
        label = F.col("vlb")
    else:
        label = F.concat_ws(".", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*parts, *more)))
    return rich.select("gid", "vid", label.alias("vlb"))


def induced_subgraph(v: DataFrame, e: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the vertices (gid, vid) of ``members`` induce."""
    keep = members.select("gid", "vid").distinct()
    ends = {c: keep.select("gid", F.col("vid").alias(c)) for c in ("src", "dst")}
    return v.join(keep, ["gid", "vid"], "left_semi"), e.join(ends["src"], ["gid", "src"], "left_semi").join(ends["dst"], ["gid", "dst"], "left_semi").select(*e.columns)


def drop_invalid(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def filter_blocks(df: DataFrame, column: str, min_len: int = 2) -> DataFrame:
    """Building blocks of more than one character."""
    return df.filter(F.length(column) >= min_len)


def minsup(df: DataFrame, fraction: float, gid: str = "gid") -> int:
    """A share of the graphs as an absolute threshold."""
    return int(df.select(gid).distinct().count() * fraction)


def flatten_numeric(df: DataFrame, sep: str = "/") -> DataFrame:
    """Numeric leaves of nested columns, named by their path."""

    def leaves(kind: T.DataType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, (*path, f.name))]
        return [path] if isinstance(kind, T.NumericType) else []

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())))


def attach_labels(v: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (gid, vid, label) put on the vertices they name."""
    return v.drop("vlb").join(labels.select("gid", "vid", F.col("label").cast("string").alias("vlb")), ["gid", "vid"], "left")


def typed_edges(e: DataFrame, kind: str = "double") -> DataFrame:
    """(gid, src, dst, weight) with the label read as a number."""
    return e.select("gid", "src", "dst", F.col("elb").cast(kind).alias("weight"))


def with_labels(v: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, slb and dlb."""
    ends = v.select("gid", F.col("vid"), F.col("vlb"))
    return e.join(ends.withColumnsRenamed({"vid": "src", "vlb": "slb"}), ["gid", "src"]).join(ends.withColumnsRenamed({"vid": "dst", "vlb": "dlb"}), ["gid", "dst"])


def graph_summary(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, n_vertices, n_edges, n_labels."""
    a = v.groupBy("gid").agg(F.count("*").alias("n_vertices"), F.countDistinct("vlb").alias("n_labels"))
    b = e.groupBy("gid").agg(F.count("*").alias("n_edges"))
    return a.join(b, "gid", "left").select("gid", "n_vertices", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_labels")


def adjacency(e: DataFrame) -> DataFrame:
    """gid, vid, neighbours: sorted array of (dst, elb) of each vertex."""
    return symmetrize(e.select("gid", "src", "dst", "elb")).groupBy("gid", F.col("src").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("dst", "elb"))).alias("neighbours"))


def adjacency_rows(e: DataFrame) -> DataFrame:
    """gid, vid, row: the rows of the weighted adjacency matrices, each as long as its graph needs (largest vid + 1)."""
    arcs = symmetrize(e.select("gid", "src", "dst", "elb"))
    sizes = arcs.groupBy("gid").agg(F.max("src").alias("last"))
    entries = arcs.groupBy("gid", "src", "dst").agg(F.sum(F.col("elb").cast("double")).alias("weight"))
    own = entries.groupBy("gid", F.col("src").alias("vid")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("own"))
    row = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0.0)))
    return own.join(sizes, "gid").select("gid", "vid", row.alias("row"))


def to_matrix(e: DataFrame, size: int) -> DataFrame:
    """The first ``size`` columns of the weighted adjacency matrices, one column per vertex; ``adjacency_rows`` has all."""
    # plain sums, where a pivot would hold an array for each vertex
    weight = F.col("elb").cast("double")
    own = (F.coalesce(F.sum(F.when(F.col("dst") == i, weight)), F.lit(0.0)).alias(str(i)) for i in range(size))
    return symmetrize(e.select("gid", "src", "dst", "elb")).groupBy("gid", F.col("src").alias("vid")).agg(*own)


def label_index(v: DataFrame) -> DataFrame:
    """Inverted index: vlb, gid, vids (sorted).  Keyed by graph too, so that a frequent label is not one row."""
    return v.groupBy("vlb", "gid").agg(F.array_sort(F.collect_list("vid")).alias("vids"))


def edge_label_index(e: DataFrame) -> DataFrame:
    return e.groupBy("elb", "gid").agg(F.array_sort(F.collect_list("eid")).alias("eids"))


def same_weight(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (gid_a, gid_b) of graphs whose weights (gid, w) sum to the same, to 6 places."""
    x = a.groupBy(F.col("gid").alias("gid_a")).agg(F.round(F.sum("w"), 6).alias("total"))
    y = b.groupBy(F.col("gid").alias("gid_b")).agg(F.round(F.sum("w"), 6).alias("total"))
    return x.join(y, "total").select("gid_a", "gid_b", "total")


def weight_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """side ('a' or 'b'), gid, total of the graphs whose weights sum to a total that both sides have, to 6 places: the pairs of
    ``same_weight`` as classes and their members, so a total that many graphs have is not all their pairs."""
    sums = [df.groupBy("gid").agg(F.round(F.sum("w"), 6).alias("total")).select(F.lit(side).alias("side"), "gid", "total") for side, df in (("a", a), ("b", b))]
    both = sums[0].unionByName(sums[1])
    met = both.groupBy("total").agg(F.count_distinct("side").alias("sides")).filter("sides = 2").select("total")
    return both.join(met, "total", "left_semi").select("side", "gid", "total")
