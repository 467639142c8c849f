"""Benchmark decontamination by greedy string tiling.

Word k-grams of each text are joined to those of the benchmark items (the seeds: what a running Karp-Rabin scan would
find).  For each text and item that share seeds, the longest match of words not yet marked is marked again and again until
none of k words is left; the tiles may stand in any order, so reordered passages count in full.  An item of which the tiles
cover ``coverage`` of the words is contained in the text.

Defined cases: null and empty texts hold nothing; an item of fewer than k words is contained where all its words stand in a
row, one without words nowhere; long texts are read whole; rows alike in id and text are tiled once; items alike are found
each on its own; of an item id with several texts each text is an item; null ids of texts stay null, items without id are
left out; with an empty table on either side nothing is found.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphset.llm.common import free_name, save, small
from graphset.llm.seeds import gram_rows

#: The shortest tile, in words.
MIN_TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6


def greedy_tiles(seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (text word, item word, length) from the k-gram matches (text word, item word), longest first."""
    diagonals: dict[int, list[int]] = {}
    for pos, at in set(seeds):
        diagonals.setdefault(pos - at, []).append(pos)
    heap: list[tuple[int, int, int]] = []

    def runs(diagonal: int, words: list[int]) -> None:
        """Push the runs of consecutive words (of the text, ascending) that are k long at least."""
        start = prev = None
        for x in [*words, None]:
            if start is not None and (x is None or x != prev + 1):
                if prev - start + 1 >= k:
                    heapq.heappush(heap, (start - prev - 1, start, start - diagonal))
                start = None
            if start is None:
                start = x
            prev = x

    for d, places in diagonals.items():
        runs(d, sorted({p + j for p in places for j in range(k)}))
    used_text: set[int] = set()
    used_item: set[int] = set()
    tiles = []
    while heap:
        negative, pos, at = heapq.heappop(heap)
        free = [pos + j for j in range(-negative) if pos + j not in used_text and at + j not in used_item]
        if len(free) == -negative:
            tiles.append((pos, at, -negative))
            used_text.update(range(pos, pos - negative))
            used_item.update(range(at, at - negative))
        else:
            runs(pos - at, free)
    return tiles


def tile_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """id, item, coverage, n_tiles, longest, tiles (array of text word, item word, length) for each contained item."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id IS NOT NULL").dropDuplicates(["id", "text"])
    # each text of an item is a passage of its own
    items = save(items.withColumn("passage", F.monotonically_increasing_id()))
    sizes = gram_rows(items, "passage", "text", (min_tile,)).filter("pos < 0 AND g0 > 0").select(F.col("key").alias("passage"), F.col("g0").alias("n_item"))
    sizes = small(items.select("id", "passage").join(sizes, "passage"))
    # lengths below the shortest tile, of which there are few: such an item's one tile is all of it
    short = sorted(r[0] for r in sizes.filter(F.col("n_item") < min_tile).select("n_item").distinct().collect())
    ks = (min_tile, *short)

    def grams_of(rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, text_hash, pos, gram: the grams of all lengths in ``ks`` (their hashes tell lengths apart)."""
        grams = gram_rows(rows, key, text, ks).filter("pos >= 0")
        if not short:
            return grams.filter("g0 IS NOT NULL").withColumnRenamed("g0", "gram")
        return grams.select("key", "text_hash", "pos", F.explode(F.array_compact(F.array(*(f"g{i}" for i in range(len(ks)))))).alias("gram"))

    seeds = gram_rows(items, "passage", "text", ks).filter("pos >= 0").join(sizes.select(F.col("passage").alias("key"), "n_item"), "key")
    own = F.coalesce(*(F.when(F.least("n_item", F.lit(min_tile)) == k, F.col(f"g{i}")) for i, k in enumerate(ks)))
    seeds = small(seeds.select(F.col("key").alias("passage"), F.col("pos").alias("at"), own.alias("gram")).filter("gram IS NOT NULL"))
    found = grams_of(docs, id_col, text_col).join(seeds, "gram")
    pairs = found.groupBy("key", "text_hash", "passage").agg(F.collect_set(F.struct("pos", "at")).alias("seeds")).join(sizes, "passage")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("at", pa.int32()), ("words", pa.int32())]))
        for batch in batches:
            tiles = [greedy_tiles([(s["pos"], s["at"]) for s in row], min(min_tile, n)) for row, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            covered = [sum(t[2] for t in row) / n for row, n in zip(tiles, batch.column(3).to_pylist(), strict=True)]
            tiles = [[dict(zip(("pos", "at", "words"), t, strict=True)) for t in row] for row in tiles]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covered, pa.float64()), pa.array(tiles, kind)], names=["key", "item", "coverage", "tiles"])

    tiled = pairs.select("key", "id", "seeds", "n_item").mapInArrow(tile, "key long, item long, coverage double, tiles array<struct<pos:int,at:int,words:int>>")
    done = tiled.filter(F.col("coverage") >= coverage)
    return done.select(F.col("key").alias(id_col), F.col("item").alias(item_col), "coverage", F.size("tiles").alias("n_tiles"), F.array_max(F.transform("tiles", lambda t: t["words"])).alias("longest"), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text contains no benchmark item; all columns stay.

    Rows are told apart by a hash of id and text, so ids may be null or repeat, and it does not matter how often or in what
    order ``docs`` is read.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = tile_benchmark(keyed, benchmark, **options, id_col=key, text_col=text_col).select(key).distinct()
    return keyed.join(small(found), key, "left_anti").select(*docs.columns)
