"""Collocations of each language: frequent phrases of two or three words that occur together more than their parts suggest.

Words are numbered once for all texts; n-grams of word numbers are counted in counting quotient filters, one for each stretch
of the corpus, whose sections are then merged across the corpus.  Only words that are frequent enough to stand in a candidate
get a number, and a piece of text is cut at the others.

A shard is some megabytes of whole texts.  It sends each of its words once, with the count, and keeps its texts as numbers of
its own words; the numbers of all words come back to a shard as one row.  So neither texts nor a dictionary of all words go
through one place, and nothing is broadcast.

Defined cases: null texts are empty, a null language is ``und``; texts without words add nothing; an empty table, or one
without frequent phrases, gives no rows.  A long text is a shard of its own.  Rows alike all count.  Columns other than text
and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.llm.common import numbered, save, small_batches
from graphset.llm.quotient_filter import Counters, Widths, counted, merged, pack, unpack

MIN_COUNT, COVER_PERCENT, TOP = 10, 50, 2_000
UNKNOWN_LANGUAGE = "und"
#: Bytes of whole texts in a shard, and texts that are looked at together.
SHARD_BYTES = 4 << 20
#: N-grams that a task gathers before it sends its filter's sections on.
GATHERED = 500_000
#: Words of the corpus for each section of the merged filters, and sections for each shuffle partition, at least.
WORDS_PER_SECTION, SECTIONS_PER_PARTITION = 500_000, 4
#: First ranking of a language's phrases is dealt over so many tasks.
RANKERS = 16

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of the texts between ``bounds``: their lower-cased strings, their texts, and whether a piece begins there."""
    kind = _KIND[data]
    solid = kind == _WORD
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    start = solid & (edge[:-1] | ~np.append(False, solid[:-1]))
    end = solid & (edge[1:] | ~np.append(solid[1:], False))
    first = np.flatnonzero(start)
    size = np.flatnonzero(end) + 1 - first
    offsets = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[solid]]))
    breaks = np.cumsum((kind == _BREAK) | edge[:-1])[first]
    return strings, np.searchsorted(bounds, first, side="right") - 1, np.append(True, breaks[1:] != breaks[:-1])[: len(first)]


def _shard(texts: pa.Array, langs: pa.Array) -> tuple[list[pa.Array], bytes] | None:
    """lang, word, code and count of each word of a language in these texts, and the texts as codes: 0 where a piece ends."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    strings, text, begins = _words(raw, bounds - bounds[0])
    if not len(strings):
        return None
    words, of = strings.dictionary_encode(), langs.dictionary_encode()
    many = len(of.dictionary)
    key = words.indices.to_numpy().astype(np.int64) * many + of.indices.to_numpy()[text]
    times = np.bincount(key, minlength=len(words.dictionary) * many)
    present = np.flatnonzero(times)
    present = present[np.argsort(-times[present], kind="stable")]
    code = np.zeros(len(times), dtype=np.int32)
    code[present] = np.arange(1, len(present) + 1)
    # a zero before each piece
    at = np.arange(len(key)) + np.cumsum(begins)
    stream = np.zeros(int(at[-1]) + 1, dtype=np.int32)
    stream[at] = code[key]
    rows = [of.dictionary.take(pa.array(present % many)), words.dictionary.take(pa.array(present // many)), pa.array(code[present]), pa.array(times[present])]
    # byte by byte, the rare high ones together, which any codec makes small
    return rows, np.ascontiguousarray(stream.view(np.uint8).reshape(-1, 4).T).tobytes()


_ENCODED = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("code", pa.int32()), ("count", pa.int64()), ("stream", pa.binary())])


def encode_shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(shard, lang, word, code, count) for each word of a shard, and (shard, stream) for the shard's texts as codes."""

    def rows(shard: int, texts: list[pa.Array], langs: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found = _shard(pa.concat_arrays(texts), pa.concat_arrays(langs))
        if found is None:
            return
        (lang, word, code, count), stream = found
        n = len(code)
        shards, none = pa.array(np.full(n, shard)), pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([shards, lang.cast(pa.string()), word.cast(pa.string()), code, count, none], schema=_ENCODED)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "stream": stream}], schema=_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        texts, langs, held = [], [], 0
        for batch in batches:
            text, lang = batch.column(0).cast(pa.large_string()), batch.column(1)
            sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(text):
                before = int(sizes[a - 1]) if a else 0
                b = min(len(text), max(a + 1, int(np.searchsorted(sizes, before + SHARD_BYTES - held, side="right"))))
                texts.append(text.slice(a, b - a))
                langs.append(lang.slice(a, b - a))
                held += int(sizes[b - 1]) - before
                a = b
                if held >= SHARD_BYTES:
                    yield from rows(shard, texts, langs)
                    shard, texts, langs, held = shard + 1, [], [], 0
        if texts:
            yield from rows(shard, texts, langs)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANGUAGE))
    schema = "shard long, lang string, word string, code int, count long, stream binary"
    return docs.select(text.alias("text"), lang.alias("lang")).mapInArrow(run, schema)


def gram_widths(n_words: int, section_bits: int) -> dict[int, Widths]:
    """Widths of the filters of two and three words, of which there are ``n_words``."""
    bits = max(1, n_words.bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 frequent words: raise the least count")
    return {2: Widths(bits, bits, min(bits, section_bits)), 3: Widths(bits, 2 * bits, min(bits, section_bits))}


def _grams(ids: np.ndarray, n: int, widths: Widths) -> Counters:
    """The filter of the n-grams of a stream of word numbers, cut at zeros."""
    ends = len(ids) - n + 1
    if ends <= 0:
        return Counters.none()
    at = np.flatnonzero(np.logical_and.reduce([ids[k : k + ends] > 0 for k in range(n)]))
    low = ids[at + 1]
    for k in range(2, n):
        low = (low << np.uint64(widths.high)) | ids[at + k]
    return counted(ids[at], low, widths)


def count_grams(streams: DataFrame, widths: dict[int, Widths], least: int) -> DataFrame:
    """(n, w1, w2, w3, a) of all n-grams that occur ``least`` times; ``streams``: (stream, codes, ids) of each shard."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Counters]] = {n: [] for n in widths}

        def sections(n: int) -> Iterator[pa.RecordBatch]:
            packed = pack(merged(held[n], widths[n]), widths[n]) if held[n] else []
            held[n] = []
            if packed:
                numbers, data = zip(*packed, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(packed), pa.int32()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], names=["n", "section", "data"])

        for batch in batches:
            for stream, codes, ids in zip(*(batch.column(k) for k in range(3)), strict=True):
                known = np.frombuffer(stream.as_buffer(), dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1)
                of = np.zeros(int(known.max()) + 1, dtype=np.uint64)
                of[codes.values.to_numpy()] = ids.values.to_numpy().astype(np.uint64)
                whole = of[known]
                for n in widths:
                    held[n].append(_grams(whole, n, widths[n]))
                    if sum(map(len, held[n])) > GATHERED:
                        held[n] = [merged(held[n], widths[n])]
                        if len(held[n][0]) > GATHERED // 2:
                            yield from sections(n)
        for n in widths:
            yield from sections(n)

    def merge(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        w = widths[n]
        total = merged([unpack(s, d, w) for s, d in zip(table.column("section").to_pylist(), table.column("data").to_pylist(), strict=True)], w)
        kept = total.count >= least
        high, low = w.restore(total.high[kept], total.low[kept])
        rest = [(low >> np.uint64(k * w.high)) & np.uint64((1 << w.high) - 1) for k in reversed(range(n - 1))]
        rest += [np.zeros(len(high), dtype=np.uint64)] * (3 - n)
        columns = [np.full(len(high), n, dtype=np.int32), *(x.astype(np.int64) for x in (high, *rest)), total.count[kept]]
        return pa.table([pa.array(c) for c in columns], names=["n", "w1", "w2", "w3", "a"])

    parts = streams.mapInArrow(gather, "n int, section long, data binary")
    return parts.groupBy("n", "section").applyInArrow(merge, "n int, w1 long, w2 long, w3 long, a long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact up to counts of 10**15."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * 1000000) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, cover: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the parts do at the cut that scores least, ``n`` how many
    words the language has.  A phrase that stands inside a longer one for ``cover`` percent of its occurrences is left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = save(encode_shards(docs, lang_col, text_col))
    vocabulary = encoded.filter("stream IS NULL").select("shard", "lang", "word", "code", "count")
    counts = save(vocabulary.groupBy("lang", "word").agg(F.sum("count").alias("f")))
    sizes = save(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = save(numbered(counts.filter(F.col("f") >= least), "lang", "word", name="id").withColumn("id", F.col("id") + 1))
    n_words, corpus = words.count(), sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sections = max(SECTIONS_PER_PARTITION * parts, corpus // WORDS_PER_SECTION)
    known = vocabulary.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list("code").alias("codes"), F.collect_list("id").alias("ids"))
    streams = encoded.filter("stream IS NOT NULL").select("shard", "stream").join(known, "shard").select("stream", "codes", "ids")
    grams = save(count_grams(streams, gram_widths(n_words, sections.bit_length()), least))

    first, second, third = (words.select(F.col("id").alias(f"w{k}"), F.col("lang"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2, 3))
    pairs = grams.filter("n = 2").select("w1", "w2", "a").join(first, "w1").join(second.drop("lang"), "w2")
    pairs = save(pairs.select("lang", "w1", "w2", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", "f1", "f2"))
    triples = grams.filter("n = 3").select("w1", "w2", "w3", "a")
    covered = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    twos = pairs.join(covered, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a")))
    twos = twos.select("lang", "phrase", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    before = pairs.select("w1", "w2", "lang", F.col("phrase").alias("before"), "f1", F.col("a").alias("a12"))
    after = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    threes = triples.join(before, ["w1", "w2"]).join(after, ["w2", "w3"]).join(third.drop("lang"), "w3")
    threes = threes.withColumn("score1", _score("a", "f1", "a23")).withColumn("score2", _score("a", "a12", "f3"))
    cut = F.col("score1") <= F.col("score2")
    threes = threes.select("lang", F.concat_ws(" ", "before", "word3").alias("phrase"), "a", F.when(cut, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(cut, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("score1", "score2").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = twos.unionByName(threes).withColumn("ranker", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "ranker").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
