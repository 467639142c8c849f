"""Merkle manifest of a dataset: one tree of digests for each source, and one over the sources' roots.

Checkpoint and recompute: of a tree's levels only every ``STRIDE``-th is stored.  A proof is taken from aligned subtrees:
the stored nodes below a stored node are gathered in one row, the missing levels between are hashed anew in that row, each
node's siblings are emitted, and the levels are dropped again.  Every step is a DataFrame expression.

Defined cases: null fields are ``-`` in a leaf; null ids come first in their source and the null source first of all; equal
ids stand in the order of their leaves, and rows alike are leaves alike, each in a place of its own.  A lone leaf is its
source's root, a lone source's root the root of all; a run without siblings adds nothing to a proof, and the proof of a leaf
without any sibling is the digest of nothing.  An empty table gives no rows.  Texts of any length are hashed whole.  Columns
beyond the five of a leaf are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.llm.common import numbered, save

#: Consecutive nodes that become one.
ARITY = 3
#: Levels from one stored level to the next; a block holds ARITY ** STRIDE nodes at most.
STRIDE = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEPS = "array<struct<left:string,right:string>>"


@dataclass
class Tree:
    """``levels[k]``: nodes (tree, idx, depth, hash) of level k * STRIDE of the trees that reach above it, the first with
    the payload of the leaves; ``roots``: (tree, hash)."""

    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    """``leaves``: trees of the leaves by source; ``top``: the tree (0) over the sources' roots; ``sources``: (source, tree, n)."""

    leaves: Tree
    top: Tree
    sources: DataFrame


def digest(*inputs: Column) -> Column:
    """Lowercase hex sha256 of the inputs, one after another."""
    return F.sha2(F.concat(*inputs), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a document row, or of the row with another text."""
    columns = [F.col(name) for name in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest(*[_field(c) for c in columns])


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: how many powers of ARITY are below n."""
    powers = F.array(*[F.lit(ARITY**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for each aligned subtree of stored nodes, its nodes in order."""
    kept = [c for c in nodes.columns if c not in ("tree", "depth")]
    block = F.expr(f"idx div {ARITY**STRIDE}").alias("block")
    return nodes.groupBy("tree", "depth", block).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("nodes"))


def _regenerated(blocks: DataFrame, level: int) -> DataFrame:
    """``blocks`` with the digests of their levels in ``level_0`` .. ``level_STRIDE``; a level above the root repeats it."""
    out = blocks.withColumn("level_0", F.col("nodes.hash"))
    for j in range(STRIDE):
        below = F.col(f"level_{j}")
        out = out.withColumn(f"level_{j + 1}", F.when(F.col("depth") > level + j, _parents(below)).otherwise(below))
    return out


def build_trees(nodes: DataFrame) -> Tree:
    """``nodes``: a written table (tree, idx from 0, depth, hash and any payload, idx first among what a block sorts by)."""
    levels, roots = [nodes], []
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level = 0
    while True:
        last = level + STRIDE
        up = _regenerated(_blocks(levels[-1].select("tree", "depth", "idx", "hash")), level)
        above = up.select("tree", "depth", F.col("block").alias("idx"), F.element_at(f"level_{STRIDE}", 1).alias("hash"))
        if last >= deepest:
            roots.append(above.select("tree", "hash"))
            break
        above = save(above)
        roots.append(above.filter(F.col("depth") <= last).select("tree", "hash"))
        levels.append(above.filter(F.col("depth") > last))
        level = last
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Tree(levels, save(out))


def _step(place: Column, j: int) -> Column:
    """What stands left and right, in its run of level j, of the node above the block's node at ``place``."""
    i = F.floor(place / ARITY**j).cast("int")
    at, run = i % ARITY, F.col(f"level_{j}")
    left = F.array_join(F.slice(run, i - at + 1, at), "")
    right = F.array_join(F.slice(run, i + 2, F.lit(ARITY - 1) - at), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _with_steps(level: int) -> Callable[[Column, Column], Column]:
    def pair(node: Column, place: Column) -> Column:
        levels = F.greatest(F.lit(0), F.least(F.lit(STRIDE), F.col("depth") - level))
        own = F.slice(F.array(*[_step(place, j) for j in range(STRIDE)]), F.lit(1), levels)
        return F.struct(node.alias("node"), F.concat(own, F.col("steps")).alias("steps"))

    return pair


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """The payload of the leaves with ``tree``, ``hash`` and ``steps``: what stands left and right of the node in each run
    from the leaf up, then the steps of ``above`` (tree, steps), which lead from the tree's root on."""
    paths: DataFrame | None = None
    for k in reversed(range(len(tree.levels))):
        level = k * STRIDE
        blocks = _blocks(tree.levels[k])
        ends = above.select("tree", F.lit(0).cast("long").alias("block"), "steps")
        if paths is None:
            joined = blocks.join(ends, ["tree", "block"])
        else:
            ending = blocks.filter(F.col("depth") <= level + STRIDE).join(ends, ["tree", "block"])
            joined = blocks.filter(F.col("depth") > level + STRIDE).join(paths, ["tree", "block"]).unionByName(ending)
        rows = _regenerated(joined, level).select("tree", "depth", "steps", "nodes", *[f"level_{j}" for j in range(STRIDE)])

        out = rows.select("tree", F.inline(F.transform("nodes", _with_steps(level)))).select("tree", "node.*", "steps")
        paths = out.select("tree", F.col("idx").alias("block"), "steps") if k else out
    return paths


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof's steps lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def build_manifest(leaves: DataFrame) -> Manifest:
    """``leaves``: source, doc_id, leaf and any payload; they are written, ranked by ranges of equal numbers of rows, and
    hashed up by source and over sources."""
    parts = max(2, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the place tells rows alike apart, so that ranges may cut anywhere
    placed = save(leaves.withColumn("place", F.monotonically_increasing_id()))
    order = ["source", "doc_id", "leaf", "place"]
    dealt = save(placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # a row for each source, and one more for each range that starts inside one
    runs = save(dealt.groupBy("part", "source").agg(F.count("*").alias("rows")))
    sources = save(numbered(runs.groupBy("source").agg(F.sum("rows").alias("n")), "source", name="tree"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    named = sources.withColumnRenamed("source", "of")
    runs = runs.join(named, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("run_part"), "of", "before", "tree", _depth(F.col("n")).alias("depth"))
    own = F.row_number().over(Window.partitionBy("part", "source").orderBy("doc_id", "leaf", "place")) - 1
    ranked = dealt.withColumn("own", own).join(runs, (F.col("part") == F.col("run_part")) & F.col("source").eqNullSafe(F.col("of")))
    payload = [c for c in leaves.columns if c not in ("source", "leaf")]
    nodes = save(ranked.select("tree", "depth", (F.col("own") + F.col("before")).alias("idx"), F.col("leaf").alias("hash"), *payload))
    trees = build_trees(nodes)
    depth = _depth(F.lit(sources.count()))
    top = build_trees(save(trees.roots.select(F.lit(0).cast("long").alias("tree"), depth.alias("depth"), F.col("tree").cast("long").alias("idx"), "hash")))
    return Manifest(trees, top, sources)


def manifest_proofs(manifest: Manifest) -> DataFrame:
    """A row for each leaf: its payload, ``hash``, ``subroot``, ``root`` and ``steps`` to the root."""
    root = manifest.top.roots.withColumnRenamed("hash", "root")
    nothing = root.select("tree", F.array().cast(_STEPS).alias("steps"))
    # a row for each source
    tops = proofs(manifest.top, nothing).join(F.broadcast(root), "tree").select(F.col("idx").alias("tree"), F.col("hash").alias("subroot"), "root", "steps")
    tops = save(tops)
    # subroot and root ride along below the steps of the source, as its last step
    marked = tops.select("tree", F.concat("steps", F.array(F.struct(F.col("subroot").alias("left"), F.col("root").alias("right")))).alias("steps"))
    out = proofs(manifest.leaves, marked)
    last = F.element_at("steps", -1)
    return out.withColumn("subroot", last["left"]).withColumn("root", last["right"]).withColumn("steps", F.slice("steps", 1, F.size("steps") - 1))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Each document's leaf, roots and proof, and whether its text, without line feeds where 2 divides the crc32 of its id,
    still leads to the root."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    stripped = leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaves = docs.select("source", "doc_id", leaf_digest().alias("leaf"), F.when(tampered, stripped).alias("tampered_leaf"))
    rows = manifest_proofs(build_manifest(leaves))
    folded = fold(F.coalesce("tampered_leaf", "hash"), F.col("steps"))
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
