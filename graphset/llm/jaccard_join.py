"""N-gram Jaccard join by vertical partitioning, and the classes of its links.

A text's set is its distinct word 5-grams (64-bit hashes, in the order of which lies the global n-gram order).  The order is
cut into fragments.

1. Each fragment counts in how many texts each of its n-grams occurs (to 255).  Put together per text, these counts tell how
   many of its n-grams another text has too.  A text with a partner shares at least the threshold of its n-grams, so all
   others are settled: they stand alone.  What is shuffled is 48 bits of each n-gram of a few MB of text and its count there,
   in packed blocks, and the counts back.  (Equal bits of different n-grams can only add to a count, hence lose nothing.)
2. The other texts, one for each distinct set, meet in each of a few bands of the order by their first n-gram there, and
   each is paired with the one of its meeting that has the fewest n-grams of its own.  Partial overlaps of these pairs are
   counted fragment by fragment and summed per pair; pairs over the threshold are links.
3. What is left is to find links between different components.  Two sets over the threshold share an n-gram among the first
   n - ceil(t n) + 1 of each, rarest first; only pairs that do so, have fitting sizes and places and lie in different
   components are counted, again by fragment.  Pairs inside a component add nothing to the result, so large groups of near copies never become all pairs.

Defined cases: null texts and texts without words have empty sets and are linked with nothing, not even each other; a text
of fewer than five words is one n-gram; very long texts are sets like any other; equal texts (also under one id) are one set,
and different texts under one id are rows of their own; every input row gives one output row, an empty table none; null ids
stay null and never are a component's id, unless all ids of a component are null.  Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphset.llm.common import join_hot, save
from graphset.llm.components import components
from graphset.llm.words import PIECE_TEXTS, Words, mix, pieces, signed

#: Words of an n-gram, and the threshold in hundredths.
WIDTH, PERCENT = 5, 80
#: Bands in which texts meet, fragments of the order in which the overlaps of pairs are counted, rounds of meetings.
BANDS, PARTS, ROUNDS = 8, 4, 2
#: Pieces of about 1 MB of text that are counted as one before they are sent: at least, and at most.
LEAST_PIECES, MOST_PIECES = 4, 64


def text_sets(w: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a piece; a text of fewer words is one n-gram."""
    at, h = w.grams(width)
    first = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.count):
        if n >= width:
            out.append(np.unique(h[first[i] : first[i + 1]]))
        elif n:
            x = np.full(1, np.uint64(1000 + n), dtype=np.uint64)
            for v in w.hash[w.first[i] : w.first[i + 1]]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + v)
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a = np.add.reduce(mix(s + np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)
    b = np.add.reduce(mix(s ^ np.uint64(0x13198A2E03707344)), dtype=np.uint64)
    return np.array([a + np.uint64(len(s)), b], dtype=np.uint64).tobytes()


def shared_counts(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, h (hash of the text), n (size of the set), cls (key of the set), shared (its n-grams that another row has too, or a
    few more), and, if these reach the threshold, seen: in how many rows each n-gram occurs, a byte each, in the order of the
    hashes.

    A piece of texts sends each of its n-grams once, with the number of its texts that have it, so an n-gram that stands in
    every text weighs no more than a piece's worth.  Pieces grow with the number of fragments, so that what a piece sends to
    a fragment stays more than a handful.
    """
    # several a task, so that tasks get about equal parts
    fragments = 4 * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = np.uint64((1 << 64) // fragments + 1)
    per_piece = min(MOST_PIECES, max(LEAST_PIECES, fragments // 1024))
    block = pa.schema([("fragment", pa.int32()), ("piece", pa.int64()), ("meta", pa.bool_()), ("data", pa.binary())])

    def parcel(piece: int, ids: pa.Array, hashes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], dtype=np.int32)
        whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(whole, kind="stable")
        whole, doc = whole[order], doc[order]
        starts = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, dtype=np.int64)
        grams, times = whole[starts], np.diff(np.append(starts, len(whole))).astype(np.uint16)
        low, mid, some = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint16), np.minimum(times, 255).astype(np.uint8)
        frag = (grams // step).astype(np.int32)
        cuts = np.flatnonzero(np.append(True, frag[1:] != frag[:-1])) if len(frag) else np.zeros(0, dtype=np.int64)
        rows = [(int(frag[x]), piece, False, low[x:y].tobytes() + mid[x:y].tobytes() + some[x:y].tobytes()) for x, y in zip(cuts, np.append(cuts[1:], len(frag)), strict=True)]
        known = np.array(ids.is_valid())
        head = np.array([len(sets), len(grams), len(whole)], dtype=np.int64)
        meta = [head, ids.fill_null(0).to_numpy().astype(np.int64), hashes.to_numpy().astype(np.int64), known.astype(np.uint8), sizes, times, doc]
        rows.append((((piece >> 32) * 7 + (piece & 0xFFFFFFFF) * 4) % fragments, piece, True, b"".join([*(x.tobytes() for x in meta), *(set_key(s) for s in sets)])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), block.types, strict=True)], schema=block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        ids, hashes, sets, held = [], [], [], 0
        for batch in batches:
            for a, b, w in pieces(batch.column(1), "solid"):
                if held == per_piece or (held and len(sets) + b - a > PIECE_TEXTS):
                    yield parcel(piece, pa.concat_arrays(ids), pa.concat_arrays(hashes), sets)
                    piece, ids, hashes, sets, held = piece + 1, [], [], [], 0
                ids.append(batch.column(0).slice(a, b - a))
                hashes.append(batch.column(2).slice(a, b - a))
                sets += text_sets(w, width)
                held += 1
        if held:
            yield parcel(piece, pa.concat_arrays(ids), pa.concat_arrays(hashes), sets)

    def count(t: pa.Table) -> pa.Table:
        """Of one fragment: for each piece, the number of texts of each n-gram, to 255."""
        rows = t.to_pylist()
        out = [(r["piece"], -1, r["data"]) for r in rows if r["meta"]]
        blocks = [r for r in rows if not r["meta"]]
        if blocks:
            sizes = [len(r["data"]) // 7 for r in blocks]
            grams, times = np.empty(sum(sizes), dtype=np.uint64), np.empty(sum(sizes), dtype=np.int64)
            at = 0
            for r, n in zip(blocks, sizes, strict=True):
                low = np.frombuffer(r["data"], dtype=np.uint32, count=n)
                mid = np.frombuffer(r["data"], dtype=np.uint16, count=n, offset=4 * n)
                grams[at : at + n] = low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32))
                times[at : at + n] = np.frombuffer(r["data"], dtype=np.uint8, count=n, offset=6 * n)
                at += n
            order = np.argsort(grams)
            s = grams[order]
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            seen = np.empty(len(s), dtype=np.uint8)
            seen[order] = np.repeat(np.minimum(np.add.reduceat(times[order], starts), 255), np.diff(np.append(starts, len(s))))
            at = 0
            for r, n in zip(blocks, sizes, strict=True):
                out.append((r["piece"], r["fragment"], seen[at : at + n].tobytes()))
                at += n
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["piece", "fragment", "data"])

    def total(t: pa.Table) -> pa.Table:
        """Of one piece: what all fragments counted, by text."""
        rows = sorted(t.to_pylist(), key=lambda r: r["fragment"])
        meta, at = rows[0]["data"], 24
        n, n_grams, n_whole = np.frombuffer(meta, dtype=np.int64, count=3)
        fields = []
        for kind, many in ((np.int64, n), (np.int64, n), (np.uint8, n), (np.int32, n), (np.uint16, n_grams), (np.uint16, n_whole)):
            fields.append(np.frombuffer(meta, dtype=kind, count=many, offset=at))
            at += fields[-1].nbytes
        ids, hashes, known, sizes, times, doc = fields
        seen = np.concatenate([np.zeros(0, dtype=np.uint8), *(np.frombuffer(r["data"], dtype=np.uint8) for r in rows[1:])])
        # fragments come in the order of the hashes, and so do a text's n-grams
        seen = np.repeat(seen, times)[np.argsort(doc, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        both = np.concatenate([[0], np.cumsum(seen > 1)])
        shared = both[ends[1:]] - both[ends[:-1]]
        kept = [seen[ends[i] : ends[i + 1]].tobytes() if sizes[i] and 100 * shared[i] >= percent * int(sizes[i]) else None for i in range(n)]
        keys = meta[at:]
        names = ["id", "h", "n", "cls", "shared", "seen"]
        cols = [pa.array(ids, mask=known == 0), pa.array(hashes), pa.array(sizes.astype(np.int64)), pa.array([keys[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(shared.astype(np.int64)), pa.array(kept, pa.binary())]
        return pa.table(cols, names=names)

    blocks = with_hash(docs, id_col, text_col).mapInArrow(cut, "fragment int, piece long, meta boolean, data binary")
    counts = blocks.groupBy("fragment").applyInArrow(count, "piece long, fragment int, data binary")
    return counts.groupBy("piece").applyInArrow(total, "id long, h long, n long, cls binary, shared long, seen binary")


def with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def set_parts(texts: DataFrame, width: int, bands: int, parts: int, percent: int) -> DataFrame:
    """Of (text, seen): cls, n, common (n-grams that are not its alone), meets (first n-gram of each band), prefix (of the
    n-grams that a partner has one of those that are not its alone, rarest first), segs (the set, cut by part)."""
    step = np.uint64((1 << 64) // parts + 1)
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, w in pieces(batch.column(0), "solid"):
                rows = []
                for i, s in enumerate(text_sets(w, width)):
                    n = len(s)
                    seen = batch.column(1)[a + i].as_py()
                    # a text of the same id that is settled already, or another version of it
                    if not n or seen is None or len(seen) != n:
                        continue
                    seen = np.frombuffer(seen, dtype=np.uint8)
                    band = s // np.uint64((1 << 64) // bands + 1)
                    firsts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
                    ends = np.searchsorted(s // step, np.arange(parts + 1))
                    rare = np.argsort(seen, kind="stable")[: n + (-percent * n) // 100 + 1]
                    rare = rare[seen[rare] > 1]
                    rows.append((set_key(s), n, int((seen > 1).sum()), signed(s[firsts]), signed(s[rare]), [s[ends[j] : ends[j + 1]].tobytes() for j in range(parts)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cls", "n", "common", "meets", "prefix", "segs"])

    return texts.mapInArrow(run, "cls binary, n long, common long, meets array<long>, prefix array<long>, segs array<binary>")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose overlap, summed over the fragments, reaches the threshold."""
    segs = sets.select("cls", "n", F.posexplode("segs").alias("part", "seg"))
    a = segs.select(F.col("cls").alias("x"), F.col("n").alias("nx"), "part", F.col("seg").alias("sx"))
    b = segs.select(F.col("cls").alias("y"), F.col("n").alias("ny"), "part", F.col("seg").alias("sy"))
    both = pairs.select("x", "y").join(a, "x").join(b, ["y", "part"]).select("x", "y", "nx", "ny", "sx", "sy")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for p, q in zip(batch.column(4), batch.column(5), strict=True):
                u, v = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                n.append(int(np.count_nonzero(v[at[at < len(v)]] == u[at < len(v)])) if len(u) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["x", "y", "nx", "ny", "common"])

    partial = both.mapInArrow(overlap, "x binary, y binary, nx long, ny long, common long")
    summed = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("common").alias("common"))
    return summed.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y")


def meetings(sets: DataFrame, turn: int) -> DataFrame:
    """Pairs (x, y): each set with the leader of each meeting it has; in the first turn the least set of its own leads."""
    rank = F.struct(*([F.col("own")] if turn == 0 else []), F.xxhash64(F.lit(turn), "cls").alias("h"), "cls")
    met = sets.select("cls", rank.alias("rank"), F.posexplode("meets").alias("band", "gram"))
    lead = met.groupBy("band", "gram").agg(F.min("rank").alias("lead"), F.max("rank").alias("last"), F.count("*").alias("sets")).filter("lead <> last").select("band", "gram", F.col("lead.cls").alias("y"), "sets")
    # near copies all come to the same meetings: hot keys
    return join_hot(met.select("cls", "band", "gram"), save(lead), ["band", "gram"], "sets").filter("cls <> y").select(F.col("cls").alias("x"), "y").distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id that links reach, its own included)."""
    rows = save(shared_counts(docs, id_col, text_col, width, percent))
    open_rows = rows.filter("seen IS NOT NULL")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "h", "seen")
    classes = save(open_rows.groupBy("cls").agg(F.min(place).alias("first"), F.min(F.col("n") - F.col("shared")).alias("own"), F.min("id").alias("least"), F.count("*").alias("rows")))
    # a class is stood for by one text of it, told by id and hash: an id may be null, or have several texts
    first = classes.select(F.col("first.id").alias("open_id"), F.col("first.h").alias("open_h"), "first.seen")
    texts = with_hash(docs, id_col, text_col)
    kept = texts.join(first, F.col("id").eqNullSafe(F.col("open_id")) & (F.col("h") == F.col("open_h"))).select("text", "seen")
    parts = set_parts(kept, width, BANDS, PARTS, percent).join(classes.select("cls", "own"), "cls")
    sets = save(parts.dropDuplicates(["cls"]))
    links: DataFrame | None = None
    for turn in range(ROUNDS):
        new = links_of(meetings(sets, turn), sets, percent)
        links = save(new if links is None else links.union(new).distinct())
    label = components(links)
    grams = sets.join(label, sets["cls"] == label["node"], "left").select("cls", "n", "common", F.coalesce("root", "cls").alias("comp"), F.posexplode("prefix").alias("at", "gram"))
    mixed = grams.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("gram")
    grams = save(grams.join(mixed, "gram", "left_semi"))
    a, b = (grams.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "common", "comp", "at"))) for s in "xy")
    fits = (F.lit(100) * F.least("n_x", "n_y") >= F.lit(percent) * F.greatest("n_x", "n_y")) & (F.col("comp_x") < F.col("comp_y"))
    # where this is the first n-gram that the pair has in common, what lies before it in either is not shared
    most = F.least(F.col("common_x") - F.col("at_x"), F.col("common_y") - F.col("at_y"))
    fits = fits & (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_x") + F.col("n_y")))
    across = a.join(b, "gram").filter(fits).select(F.col("cls_x").alias("x"), F.col("cls_y").alias("y")).distinct()
    links = save(links.union(links_of(across, sets, percent)))
    label = components(links)
    # classes get the least id of their component, then rows that of their class; large components and classes are hot keys
    named = save(classes.join(label, classes["cls"] == label["node"], "left").select("cls", "least", "rows", F.coalesce("root", "cls").alias("comp")))
    first = save(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    ids = save(join_hot(named, first, ["comp"], "classes").select("cls", "rows", "component_id"))
    named = join_hot(open_rows.select("id", "n", "cls"), ids, ["cls"], "rows").select("id", "n", "component_id")
    alone = rows.filter("seen IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = named.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
