"""Substring dedup by hashing lines, paragraphs, sentences within lines (passages are often pasted into the middle of a
line), and runs of short sentences.

A unit is normalised to its words (letters and digits, lower-case) and digested to 128 bits.  Digests are grouped globally;
of each digest the earliest occurrence (by id, then offset) stays.  Later ones that follow each other without a word between
them are a repeated stretch; one of at least ``min_words`` words, with a unit of ``RUN_WORDS`` in it, is removed, that is,
its units are reported with their offsets in the original text.  So is any later line or paragraph of at least ``line_words``
words on its own.  Shorter ones (greetings, notices, labels, which many documents share) stay.

From each short sentence, forwards and backwards, the fewest sentences that hold ``RUN_WORDS`` words are a unit too, so
passages are found whatever the length of their lines.  A sentence ends at .!? before white space, symbols between them
aside; a paragraph ends at a blank line.  What a unit shares with the place that stays is not cut.

Defined cases: null and empty texts have no units; units of one word are looked at in runs only; long texts are looked at
whole; of rows alike in id and text (the id may be null) all but one are cut whole, from their first word to the last, if they
have ``line_words`` words, and units of theirs that stand elsewhere before are cut from all of them; a null id ranks last; texts of one id rank by a
hash; an empty table gives an empty result.  Other columns, whatever their names, are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.llm.common import free_name, join_hot, save
from graphset.llm.quality import each_piece
from graphset.llm.words import mix, signed

#: Words from which a repeated stretch is removed, that a line, a paragraph or a run of sentences has at least, and from which
#: a sentence is looked at.
MIN_WORDS, RUN_WORDS, LEAST_WORDS = 20, 8, 2
#: Words from which a repeated line or paragraph is removed on its own.
LINE_WORDS = 14
_Q = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_Q_INV = tuple(np.uint64(pow(int(q), -1, 1 << 64)) for q in _Q)


def _unit_digest(words: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int, which: int) -> np.ndarray:
    """Digest of the words first..last (exclusive) of each unit."""
    n = len(words)
    up = np.full(n + 1, _Q[which], dtype=np.uint64)
    down = np.full(n + 1, _Q_INV[which], dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) + np.uint64(salt << 32))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, min_words: int = RUN_WORDS) -> DataFrame:
    """id, text_hash, kind (0 line, 1 sentence, 2 paragraph, 3 run), word (number of the unit's first word), start, stop
    (characters), words, d1, d2; units of the same words of a text are one, and alike across the kinds."""
    out = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("kind", pa.int32()), ("word", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, data, bounds in each_piece(batch, 1):
                if not len(data) or not len(w.hash):
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)], dtype=np.int32)
                space = np.isin(data, np.frombuffer(b" \t\n\r\v\f", dtype=np.uint8))
                #: Behind the last solid byte before each place.
                solid = np.concatenate([[0], np.maximum.accumulate(np.where(space, np.int32(0), np.arange(1, len(data) + 1, dtype=np.int32)))], dtype=np.int32)
                ids, text_hashes = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)
                newline = np.flatnonzero(data == 10)
                stop = np.flatnonzero(np.isin(data, np.frombuffer(b".!?", dtype=np.uint8)))
                gaps = np.append(np.flatnonzero(space), len(data))
                gap = gaps[np.searchsorted(gaps, stop)]
                stop = gap[gap <= np.append(w.start, len(data))[np.searchsorted(w.start, stop)]]
                sentence = np.unique(np.concatenate([newline + 1, stop, bounds]))
                blank = newline[1:][solid[newline[1:]] <= newline[:-1]]
                found = []
                for kind, edges in ((0, np.unique(np.concatenate([newline + 1, bounds]))), (2, np.unique(np.concatenate([blank + 1, bounds]))), (1, sentence)):
                    first, last = np.searchsorted(w.start, edges[:-1]), np.searchsorted(w.start, edges[1:])
                    use = np.flatnonzero(last - first >= (least if kind == 1 else min_words))
                    found.append((first[use], last[use], edges[use + 1], np.full(len(use), kind, dtype=np.int32)))
                some = np.flatnonzero(last > first)
                first, last, ends = first[some], last[some], sentence[some + 1]
                every = np.arange(len(some))
                ahead = np.searchsorted(last, first + min_words)
                back = np.searchsorted(first, last - min_words, side="right") - 1
                i, j = np.concatenate([every, back]), np.concatenate([ahead, every])
                inside = (i >= 0) & (j < len(some)) & (i < j)
                i, j = i[inside], j[inside]
                same = w.doc[first[i]] == w.doc[first[j]]
                i, j = i[same], j[same]
                found.append((first[i], last[j], ends[j], np.full(len(i), 3, dtype=np.int32)))
                f, z, end, kinds = (np.concatenate(x) for x in zip(*found, strict=True))
                one = np.unique(f * (len(w.hash) + 1) + z, return_index=True)[1]
                f, z, end, kinds = f[one], z[one], solid[end[one]], kinds[one]
                doc = w.doc[f]
                # from the first word to the end of the unit, without white space behind
                begin = w.start[f]
                cols = [
                    ids.take(pa.array(doc)),
                    text_hashes.take(pa.array(doc)),
                    pa.array(kinds),
                    pa.array((f - w.first[doc]).astype(np.int32)),
                    pa.array((chars[begin] - chars[bounds[doc]]).astype(np.int32)),
                    pa.array((chars[end] - chars[bounds[doc]]).astype(np.int32)),
                    pa.array((z - f).astype(np.int32)),
                    *(pa.array(signed(_unit_digest(w.hash, f, z, 0, i))) for i in (0, 1)),
                ]
                whole = pa.RecordBatch.from_arrays(cols, schema=out)
                for at in range(0, len(whole), 1 << 16):
                    yield whole.slice(at, 1 << 16)

    schema = "id long, text_hash long, kind int, word int, start int, stop int, words int, d1 long, d2 long"
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """id, text_hash, kind, start, stop, words, kept_id, kept_start, rows of every unit to remove; ``rows`` is the number of rows
    alike that it is removed from (of kind row: all but one)."""

    def packed(high: str, low: Column) -> Column:
        return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(low.cast("long"))

    # two numbers instead of five in what is shuffled
    all_units = units(docs, id_col, text_col, min_words=run_words).select("d1", "d2", "id", "text_hash", packed("start", F.col("stop")).alias("span"), packed("word", F.col("words") * 4 + F.col("kind")).alias("more"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "span")
    which = F.xxhash64("id", "text_hash", "span")
    found = all_units.groupBy("d1", "d2").agg(F.min(place).alias("keep"), F.min(which).alias("a"), F.max(which).alias("b"), F.count("*").alias("n")).filter("a <> b").select("d1", "d2", "keep", "n")
    # a common line is a hot digest: counted before the shuffle, then joined by parts
    later = join_hot(all_units, save(found), ["d1", "d2"], "n").filter("NOT (id <=> keep.id AND text_hash = keep.text_hash AND span = keep.span)").drop("d1", "d2", "n")
    # rows alike in id and text are one, before they meet in one window
    later = later.distinct().select(
        "id",
        "text_hash",
        F.shiftright("span", 32).cast("int").alias("start"),
        F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("stop"),
        F.shiftright("more", 32).cast("int").alias("word"),
        F.shiftright(F.col("more").bitwiseAND(0xFFFFFFFF), 2).cast("int").alias("words"),
        F.col("more").bitwiseAND(3).cast("int").alias("kind"),
        F.struct("keep.id", "keep.text_hash", F.shiftright("keep.span", 32).cast("int").alias("start"), F.col("keep.span").bitwiseAND(0xFFFFFFFF).cast("int").alias("stop")).alias("keep"),
    )
    by_text = Window.partitionBy("id", "text_hash")
    end = F.col("word") + F.col("words")
    before = F.max(end).over(by_text.orderBy("word", end).rowsBetween(Window.unboundedPreceding, -1))
    joined = later.withColumn("new", F.coalesce(F.col("word") > before, F.lit(True)).cast("int"))
    joined = joined.withColumn("stretch", F.sum("new").over(by_text.orderBy("word", end).rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "text_hash", "stretch")
    marked = joined.withColumns({"in_all": F.max(end).over(whole) - F.min("word").over(whole), "longest": F.max("words").over(whole)})
    alone = F.col("kind").isin(0, 2) & (F.col("words") >= line_words)
    marked = marked.filter(alone | (F.col("in_all") >= min_words) & (F.col("longest") >= run_words))
    # a run that overlaps the place that stays goes only from there on
    own = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    marked = marked.withColumn("start", F.when(own, F.greatest("start", "keep.stop")).otherwise(F.col("start"))).filter("start < stop").dropDuplicates(["id", "text_hash", "kind", "start", "stop"])
    kind = F.element_at(F.array(*map(F.lit, ("line", "sentence", "paragraph", "run"))), F.col("kind") + 1)
    out = marked.select("id", "text_hash", kind.alias("kind"), "start", "stop", "words", F.col("keep.id").alias("kept_id"), F.col("keep.start").alias("kept_start"))
    text = F.col(text_col).cast("string")
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).cast("long").alias("like_id"), F.xxhash64(text).alias("like_hash"), text.alias("text"))
    alike = save(rows.groupBy("like_id", "like_hash").agg(F.count("*").alias("like")).filter("like > 1"))
    out = out.withColumn("rows", F.lit(1).cast("long"))
    if not alike.isEmpty():
        same = F.col("id").eqNullSafe(F.col("like_id")) & (F.col("text_hash") == F.col("like_hash"))
        out = out.join(alike, same, "left").withColumn("rows", F.coalesce("like", "rows")).drop(*alike.columns)
        named = alike.select(F.col("like_id").alias("id"), "like_hash")
        one = rows.join(named, rows["like_id"].eqNullSafe(named["id"]) & (rows["like_hash"] == named["like_hash"]), "left_semi").groupBy("like_id", "like_hash").agg(F.min("text").alias("text"))
        of = units(one, "like_id", "text", min_words=1).groupBy("id", "text_hash").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max(end) - F.min("word")).alias("words"))
        whole = of.filter(F.col("words") >= line_words).join(alike, same)
        out = out.unionByName(whole.select("id", "text_hash", F.lit("row").alias("kind"), "start", "stop", "words", F.col("id").alias("kept_id"), F.col("start").alias("kept_start"), (F.col("like") - 1).alias("rows")))
    return out.withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of the texts; all columns and rows stay.

    Rows are written once with a number each, so that of rows alike the same one stays whatever becomes of executors.  Spans
    meet them by id and a hash of the text, so ids may be null, or have several texts.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    key = F.xxhash64(F.col(f"row.`{id_col}`").cast("long"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string"))).alias("key")
    rows = save(docs.select(F.struct(*(docs[n] for n in names)).alias("row"), F.monotonically_increasing_id().alias("place")))
    rows = rows.select("row", "place", key)
    found = save(repeated_units(rows.select("row.*"), id_col, text_col, min_words, line_words=line_words))
    found = found.select(F.xxhash64(id_col, "text_hash").alias("key"), F.struct("start", "stop").alias("span"), (F.col("kind") == "row").alias("whole"))
    parts = found.groupBy("key").agg(F.collect_list(F.when(~F.col("whole"), F.col("span"))).alias("parts"), F.collect_list(F.when(F.col("whole"), F.col("span"))).alias("whole"))
    values = save(rows.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).join(parts, "key", "left"))
    cuts, spans = free_name(docs, "row_cuts"), F.when(F.col("place") == F.col("first"), F.col("parts")).otherwise(F.concat("parts", "whole"))
    joined = join_hot(rows, values, ["key"], "n").select("row.*", spans.alias(cuts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text is not None and gone:
                    out, pos = [], 0
                    for start, stop in sorted((s["start"], s["stop"]) for s in gone):
                        out.append(text[pos : max(pos, start)])
                        pos = max(pos, stop)
                    text = "".join([*out, text[pos:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)
