"""Word vectors by skip-gram with negative sampling, trained over blocks of the vocabulary that tasks hand on to each other.

Words are dealt to blocks by a hash.  In a step, each task holds one block of word vectors and one block of context vectors, no
block twice, and works on the pairs of a word and a context that lie between the two; after a step the context blocks move on
by one, so after as many steps as there are blocks all pairs have been seen.  No task holds more than two blocks and the
distinct pairs between them, nothing is averaged, and a rerun gives the same vectors.

Pairs are counted once for the whole corpus; a pair at distance d in a window of w counts (w - d + 1) / w times, as if windows
were drawn at random.  In a step every pair is met with its whole count: as many times as it counts, or, if that is more than
``ROUNDS``, in so many meetings that share the count as their weight.  Each meeting draws some other contexts of its block, by
their counts to the power 0.75, and they weigh as much as it does.  So the work follows the distinct pairs, not how often a large
corpus repeats them.  A word moves by the plain gradient until it has moved by about ``REACH`` in all; from then on its steps
shrink (AdaGrad, one sum for each vector), so that words that are met very often neither overshoot nor forget other blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphset.storage import is_small, numbered, save

#: Pairs that are taken together; a word in several of them moves by the sum of what each asks for.
BATCH = 1024
#: Meetings of a pair in a step at most; a pair of a higher count weighs more in each.
ROUNDS = 32
#: Way of a vector from which its steps shrink.
REACH = 1.0
_POWER = 0.75


def vocabulary(tokens: DataFrame, min_count: int, blocks: int) -> DataFrame:
    """token, n, id, block of the words that occur at least ``min_count`` times."""
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return save(numbered(counts, "token", name="id").withColumn("block", F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int")))


def _lines(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """ids, blocks of the known words of each sentence, in order.  Where the vocabulary is small enough to be sent to all
    executors, sentences stay where they lie; else each word meets its number in a join."""
    if is_small(words):
        # at most BROADCAST_ROWS of them
        known = words.filter("token IS NOT NULL").select("token", "id", "block").toPandas()
        of, ids, blocks = pa.array(known["token"], pa.string()), known["id"].to_numpy(np.int64), known["block"].to_numpy(np.int32)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                at = pc.index_in(lists.flatten(), value_set=of)
                here = pc.is_valid(at).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                ends = pa.array(np.concatenate([[0], np.cumsum(here)])[ends].astype(np.int32))
                at = at.to_numpy(zero_copy_only=False)[here].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x[at])) for x in (ids, blocks)], names=["ids", "blocks"])

        return tokens.filter(F.size("tokens") > 0).select("tokens").mapInArrow(number, "ids array<long>, blocks array<int>")
    at = tokens.select("gid", F.posexplode("tokens").alias("pos", "token")).join(words.select("token", "id", "block"), "token")
    lines = at.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "block"))).alias("line"))
    return lines.select(F.col("line.id").alias("ids"), F.col("line.block").alias("blocks"))


def _pairs_of(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of lines (ids, blocks), summed inside each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blocks = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            line = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(0)).to_numpy())
            words, first, at = np.unique(ids, return_index=True, return_inverse=True)
            block = blocks[first]
            keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for d in range(1, window + 1):
                near = np.flatnonzero(line[:-d] == line[d:])
                new, n = np.unique(at[near] * len(words) + at[near + d], return_counts=True)
                # both ways
                new = np.concatenate([keys, new, new % len(words) * len(words) + new // len(words)])
                keys, place = np.unique(new, return_inverse=True)
                sums = np.bincount(place, weights=np.concatenate([sums, np.tile(n * (window - d + 1), 2)]), minlength=len(keys)).astype(np.int64)
            w, c = keys // max(len(words), 1), keys % max(len(words), 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words[w], words[c], block[w], block[c], sums)], names=["w", "c", "bw", "bc", "n"])

    return count


def pair_counts(tokens: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """w, c, bw, bc, n: how often (by distance) word and context stand together; rare words are skipped, as if not there."""
    pairs = _lines(tokens, words).mapInArrow(_pairs_of(window), "w long, c long, bw int, bc int, n long")
    return pairs.groupBy("w", "c", "bw", "bc").agg((F.sum("n") / window).alias("n"))


def _first_vectors(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small random vectors that hang on a word's number only."""
    if not len(ids):
        return np.zeros((0, size))
    return np.stack([np.random.default_rng([seed, int(i)]).random(size) - 0.5 for i in ids]) / size


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``rows`` by their places ``at``, from 0 to ``size`` - 1."""
    return np.stack([np.bincount(at, weights=x, minlength=size) for x in rows.T], axis=1)


def _move(vectors: np.ndarray, way: np.ndarray, at: np.ndarray, by: np.ndarray, share: float) -> None:
    """Vectors ``at`` move by ``share`` of what is asked for, less the farther they were asked to go before."""
    way[at] += (by * by).sum(axis=1)
    vectors[at] += share * by / np.sqrt(1 + way[at] / REACH**2)[:, None]


def meetings(n: np.ndarray, draw: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each round, in any order, and their weights, which sum to ``n`` over all rounds."""
    times = np.clip(np.ceil(n), 1, ROUNDS)
    weight, late = n / times, draw.random(len(n))
    for r in range(ROUNDS):
        here = np.flatnonzero(np.floor((r + 1) / ROUNDS * times + late) > np.floor(r / ROUNDS * times + late))
        draw.shuffle(here)
        yield here, weight[here]


def _learner(size: int, negative: int, seed: int, step: int, rate: float, share: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Work on the pairs between a block of words and one of contexts, at ``share`` of the rate."""

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("kind", "ascending"), ("id", "ascending")])
        kind = right.column("kind").to_numpy()
        vectors, way = np.array(right.column("vector").to_pylist()).reshape(len(kind), size), np.array(right.column("way").to_numpy())
        ids = right.column("id").to_numpy()
        own, other = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        x, y, x_way, y_way = vectors[own], vectors[other], way[own], way[other]
        if len(left) and len(own) and len(other):
            left = left.sort_by([("w", "ascending"), ("c", "ascending")])
            w, c = np.searchsorted(ids[own], left.column("w").to_numpy()), np.searchsorted(ids[other], left.column("c").to_numpy())
            other_share = np.cumsum(right.column("n").to_numpy()[other] ** _POWER)
            draw = np.random.default_rng([seed, step, int(left.column("g")[0].as_py())])
            for here, weight in meetings(left.column("n").to_numpy(), draw):
                for begin in range(0, len(here), BATCH):
                    pick, much = here[begin : begin + BATCH], rate * weight[begin : begin + BATCH, None]
                    false = np.searchsorted(other_share, draw.random((len(pick), negative)) * other_share[-1], side="right")
                    a, b = w[pick], np.concatenate([c[pick][:, None], false], axis=1)
                    right_one = np.zeros(b.shape)
                    right_one[:, 0] = 1
                    # a false context that is the true one teaches nothing
                    use = np.concatenate([np.ones((len(pick), 1), dtype=bool), false != c[pick][:, None]], axis=1)
                    u, v = x[a], y[b]
                    g = much * use * (right_one - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", u, v), -30, 30))))
                    rows, at_row = np.unique(a, return_inverse=True)
                    columns, at_column = np.unique(b.ravel(), return_inverse=True)
                    to_u, to_v = np.einsum("bk,bkd->bd", g, v), (g[:, :, None] * u[:, None, :]).reshape(-1, size)
                    _move(x, x_way, rows, _sums(at_row, to_u, len(rows)), share)
                    _move(y, y_way, columns, _sums(at_column, to_v, len(columns)), share)
            vectors[own], vectors[other], way[own], way[other] = x, y, x_way, y_way
        return pa.table([right.column("id"), right.column("block"), right.column("n"), right.column("kind"), pa.array(list(vectors), pa.list_(pa.float64())), pa.array(way)], names=["id", "block", "n", "kind", "vector", "way"])

    return learn


def train_skip_gram(tokens: DataFrame, size: int = 100, window: int = 10, min_count: int = 3, iterations: int = 5, blocks: int = 4, negative: int = 5, rate: float = 0.025, seed: int = 42) -> DataFrame:
    """token, vector of every word of (gid, tokens) that occurs at least ``min_count`` times; a written table.

    Empty sentences, and those of one word, add no pairs; a word without pairs keeps its first, random vector; a corpus without
    frequent words gives no rows.
    """
    words = vocabulary(tokens, min_count, blocks)
    pairs = save(pair_counts(tokens, words, window))

    def start(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        first = _first_vectors(ids, size, seed)
        both = [(0, first), (1, np.zeros_like(first))]
        parts = [pa.table([t.column("id"), t.column("block"), t.column("n"), pa.array(np.full(len(ids), k, dtype=np.int32)), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.zeros(len(ids)))], names=["id", "block", "n", "kind", "vector", "way"]) for k, x in both]
        return pa.concat_tables(parts)

    schema = "id long, block int, n long, kind int, vector array<double>, way double"
    state = save(words.select("id", "block", "n").groupBy("block").applyInArrow(start, schema))
    steps = iterations * blocks
    for step in range(steps):
        shift, share = step % blocks, max(1 - step / steps, 1e-4)

        # the context block that is ``shift`` further on comes to this one
        holder = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks)))
        due = pairs.filter(F.pmod(F.col("bc") - F.col("bw"), F.lit(blocks)) == shift).withColumn("g", F.col("bw"))
        state = save(due.groupBy("g").cogroup(state.withColumn("g", holder).groupBy("g")).applyInArrow(_learner(size, negative, seed, step, rate, share), schema))
    return save(state.filter("kind = 0").join(words.select("id", "token"), "id").select("token", "vector"))
