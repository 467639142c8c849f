"""A map of vectors in the plane on which near vectors stay near: neighbours pull, everything else pushes.

Neighbours are searched in cells around pivots: a vector is kept in the ``PROBES`` cells whose pivots are nearest to it, and asks
in its own; a crowded cell is cut into blocks.  From the first two principal components on, rounds move all points at once.
In a round each point meets the places of its neighbours, and a summary of all others on a grid (how many, and their mean, in
each square), with both of which it takes a few steps.  Pivots are fitted on a bounded sample, the grid has a bounded number of
squares; nothing else leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.operators.vectors import project_2d
from graphset.storage import save

#: Vectors that pivots are fitted on, vectors for each pivot, pivots at most, cells that a vector is kept in, vectors of a block.
SAMPLE, VECTORS_PER_PIVOT, MOST_PIVOTS, PROBES, BLOCK = 4_096, 256, 256, 4, 2_048
#: Squares of the grid along each side, steps of a point in a round, and the greatest length of a step.
GRID, STEPS, STRIDE = 32, 5, 0.5


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _pivots(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(count, len(centres))).astype(int)]
    for _ in range(rounds):
        own = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.stack([sample[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """a, b, rank (from 1), d: for each row of a written table (id, vector: doubles of one length) its ``k`` nearest others,
    as far as they are kept in its cell."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    if not sample:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1).alias("rank"), F.lit(0.0).alias("d")).limit(0)
    dim = len(sample[0][0])
    pivots = _pivots(np.array([r[0] for r in sample]), min(MOST_PIVOTS, max(1, rows.count() // VECTORS_PER_PIVOT)))

    def keyed(probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                cells = np.argsort((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.reshape(-1).astype(np.int32))], names=["id", "vector", "cell"])

        return run

    schema = T.StructType([*rows.select("id", "vector").schema.fields, T.StructField("cell", T.IntegerType())])
    kept = save(rows.select("id", "vector").mapInArrow(keyed(PROBES), schema))
    asking = rows.select("id", "vector").mapInArrow(keyed(1), schema)
    # at most MOST_PIVOTS rows
    cuts = F.broadcast(save(kept.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))
    kept = save(kept.join(cuts, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"))
    asking = asking.join(cuts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    kind = rows.schema["id"].dataType

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            x, y = (_matrix(t.column("vector").combine_chunks(), dim) for t in (left, right))
            names, others = left.column("id").to_pylist(), np.array(right.column("id").to_pylist())
            for at in range(0, len(x), 512):
                d = ((x[at : at + 512] ** 2).sum(1)[:, None] - 2 * x[at : at + 512] @ y.T + (y**2).sum(1)).clip(0)
                for i, own in enumerate(d):
                    near = np.lexsort((others, own))[: k + 1]
                    out += [(names[at + i], others[j].item(), float(own[j])) for j in near if others[j] != names[at + i]]
        a, b, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, left.column("id").type), pa.array(b, left.column("id").type), pa.array(d, pa.float64())], names=["a", "b", "d"])

    found = asking.groupBy("cell", "block").cogroup(kept.groupBy("cell", "block")).applyInArrow(search, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("d", T.DoubleType())]))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return save(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "b", "rank", F.sqrt("d").alias("d")))


def neighbour_map(df: DataFrame, id_col: str = "id", column: str = "vector", k: int = 10, rounds: int = 16) -> DataFrame:
    """id, x, y of each row with an id and a vector; vectors have one length, ids are unique.

    Rows without neighbours (there is but one) keep their principal components; an empty table gives no rows.
    """
    rows = save(df.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("vector")).dropna())
    if rows.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    near = nearest(rows, k)
    # what either calls near pulls both
    pulls = near.select("a", "b").union(near.select("b", "a")).distinct()
    flat = project_2d(rows).select("id", "x", "y")
    spread = flat.agg(F.coalesce(F.stddev("x"), F.lit(0.0)), F.coalesce(F.stddev("y"), F.lit(0.0)), F.avg("x"), F.avg("y")).first()
    points = save(flat.select("id", *(((F.col(c) - m) / (s or 1.0) * 5).alias(c) for c, s, m in (("x", spread[0], spread[2]), ("y", spread[1], spread[3])))))
    schema = T.StructType([points.schema["id"], T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    for turn in range(rounds):
        low_x, high_x, low_y, high_y, many = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
        square = [F.least(F.floor((F.col(c) - low) / max(high - low, 1e-9) * GRID), F.lit(GRID - 1)) for c, low, high in (("x", low_x, high_x), ("y", low_y, high_y))]
        # at most GRID * GRID rows
        cells = points.groupBy(square[0].alias("i"), square[1].alias("j")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("i", "j").collect()
        count, centre = np.array([c["n"] for c in cells], dtype=float), np.array([[c["x"], c["y"]] for c in cells])
        at = points.select(F.col("id").alias("b"), F.struct("x", "y").alias("place"))
        around = pulls.join(at, "b").groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("place")).alias("near"))
        met = points.join(around, "id", "left").select("id", "x", "y", "near.x", "near.y").toDF("id", "x", "y", "nx", "ny")
        rate = STRIDE * (1 - turn / rounds)

        def move(batches: Iterator[pa.RecordBatch], count: np.ndarray = count, centre: np.ndarray = centre, rate: float = rate, many: int = many) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).copy()
                sizes = np.array([len(v) if v is not None else 0 for v in batch.column(3).to_pylist()], dtype=int)
                q = np.stack([batch.column(c).drop_null().flatten().to_numpy() for c in (3, 4)], axis=1)
                own = np.repeat(np.arange(len(p)), sizes)
                for _ in range(STEPS):
                    gap = q - p[own]
                    pull = np.zeros_like(p)
                    np.add.at(pull, own, gap / (1 + (gap**2).sum(1))[:, None])
                    pull /= np.maximum(sizes, 1)[:, None]
                    away = p[:, None, :] - centre[None]
                    weight = count / (1 + (away**2).sum(2)) ** 2
                    push = (weight[:, :, None] * away).sum(1) / many
                    step = pull + 10 * push
                    size = np.linalg.norm(step, axis=1, keepdims=True)
                    p += rate * step / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["id", "x", "y"])

        points = save(met.mapInArrow(move, schema))
    return points.withColumnRenamed("id", id_col)
