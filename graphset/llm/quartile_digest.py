"""Quartile bucket digests of documents: texts that share most of their bytes get digests that differ little.

Every byte opens a window of four; its three triplets that hold the first byte are hashed into ``BUCKETS`` buckets and counted.
A digest is the text's length on a logarithmic scale (one byte) and, for each bucket, which quarter of the buckets its count
falls in (two bits), in hex.  ``likeness`` scores two digests from 0 (no more alike than chance) to 1 (equal).

Defined cases: a null text is an empty one; texts under three bytes have no triplet, so all their buckets are in the lowest
quarter and only the length tells them apart; texts of any length are counted whole.  Buckets with the same count are in the
same quarter.  A null digest, or one that is none, has a likeness of null.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.llm.common import save

BUCKETS = 256
#: Each byte of length code stands for texts up to so many times longer.
LENGTH_STEP = 1.1
#: Share of the length in a difference; so many codes apart count in full.
LENGTH_SHARE, LENGTH_CODES = 0.1, 16
#: What two unrelated digests differ by in a bucket, on average, if all quarters are equally frequent.
CHANCE = 1.25
#: Bytes and texts that are counted at once; a longer text is cut into such parts, whose counts are added.
PIECE_BYTES, PIECE_TEXTS = 1 << 20, 2_048
#: Ranges of documents for each shuffle partition.
RANGES = 8

_HEX = 2 + BUCKETS // 2
_WEIGHTS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_SALTS = [np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0x2545F491)]
_SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())


def _bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: np.uint32) -> np.ndarray:
    h = (a * _WEIGHTS[0]) ^ (b * _WEIGHTS[1]) ^ (c * _WEIGHTS[2]) ^ salt
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> _SHIFT


def _count(data: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Triplets by text and bucket; ``text`` is the place of the text that each byte belongs to."""
    total = np.zeros(texts * BUCKETS, dtype=np.int64)
    x = data.astype(np.uint32)
    for (i, j), salt in zip(((1, 2), (1, 3), (2, 3)), _SALTS, strict=True):
        n = len(x) - j
        if n > 0:
            inside = text[:n] == text[j:]
            key = text[:n] * BUCKETS + _bucket(x[:n], x[i : i + n], x[j:], salt)
            total += np.bincount(key[inside], minlength=len(total))
    return total.reshape(texts, BUCKETS)


def _counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Triplets by text and bucket of the texts between ``bounds``, by pieces of them."""
    n = len(bounds) - 1
    if bounds[-1] - bounds[0] <= 2 * PIECE_BYTES:
        part = data[bounds[0] : bounds[-1]]
        return _count(part, np.repeat(np.arange(n), np.diff(bounds)), n)
    # one long text: a part's last triplets reach three bytes into the next part, and are taken off where they count twice
    total = np.zeros((1, BUCKETS), dtype=np.int64)
    for a in range(int(bounds[0]), int(bounds[1]), PIECE_BYTES):
        b = min(a + PIECE_BYTES + 3, int(bounds[1]))
        total += _count(data[a:b], np.zeros(b - a, dtype=np.int64), 1)
        if b < bounds[1]:
            total -= _count(data[b - 3 : b], np.zeros(3, dtype=np.int64), 1)
    return total


def _codes(counts: np.ndarray) -> np.ndarray:
    """The quarter, 0 to 3, of each bucket."""
    ranks = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    quartiles = np.partition(counts, ranks, axis=1)[:, ranks]
    return (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2, dtype=np.uint8)


def _length_code(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(np.log(np.maximum(n_bytes, 0) + 1) / np.log(LENGTH_STEP))).astype(np.uint8)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), bounds


def digests(texts: pa.Array) -> list[str]:
    """The digests of a batch of texts."""
    data, bounds = _buffers(texts)
    out: list[str] = []
    a, rows = 0, len(bounds) - 1
    while a < rows:
        b = int(np.searchsorted(bounds, bounds[a] + PIECE_BYTES, side="right")) - 1
        b = min(max(b, a + 1), rows, a + PIECE_TEXTS)
        own = bounds[a : b + 1]
        codes = _codes(_counts(data, own)).reshape(b - a, BUCKETS // 4, 4)
        packed = (codes << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        whole = np.concatenate([_length_code(np.diff(own))[:, None], packed], axis=1)
        out += [row.tobytes().hex() for row in whole]
        a = b
    return out


def digest_of(text: str | None) -> str:
    return digests(pa.array([text], pa.string()))[0]


def likenesses(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """Likeness of each pair of digests."""
    usable = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and len(x) == len(y) == _HEX]
    out: list[float | None] = [None] * len(a)
    shifts = np.array([6, 4, 2, 0], dtype=np.uint8)
    for start in range(0, len(usable), PIECE_TEXTS):
        some = usable[start : start + PIECE_TEXTS]
        x, y = (np.frombuffer(bytes.fromhex("".join(side[i] for i in some)), dtype=np.uint8).reshape(len(some), -1) for side in (a, b))
        quarters = [((z[:, 1:, None] >> shifts) & 3).astype(np.int16) for z in (x, y)]
        buckets = np.abs(quarters[0] - quarters[1]).sum(axis=(1, 2)) / (CHANCE * BUCKETS)
        lengths = np.abs(x[:, 0].astype(np.int16) - y[:, 0]) / LENGTH_CODES
        score = 1 - (1 - LENGTH_SHARE) * np.minimum(1, buckets) - LENGTH_SHARE * np.minimum(1, lengths)
        for i, s in zip(some, np.maximum(0, score).tolist(), strict=True):
            out[i] = s
    return out


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of digests."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(likenesses([v if isinstance(v, str) else None for v in x], [v if isinstance(v, str) else None for v in y]), dtype="float64")

    return score(a, b)


def _appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def with_digests(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _appended(batch, {name: pa.array(digests(batch.column(text_col)), pa.string())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def _key(doc_id: int | None, text_hash: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, text_hash


def _range_starts(keys: DataFrame) -> list[tuple[bool, int, int]]:
    """The first key of each of some ranges of equal numbers of rows, in order: RANGES for each shuffle partition at most."""
    ranges = RANGES * max(2, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keys.repartitionByRange(ranges, "doc_id", "text_hash").groupBy(F.spark_partition_id().alias("range"))
    return sorted(_key(r.first.doc_id, r.first.text_hash) for r in dealt.agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).collect())


_DEALT = "doc_id long, text string, text_hash long, n_chars long, copies long, fingerprint string, range int, lends boolean"


def _dealer(starts: list[tuple[bool, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their digest and range; the first row of a range also goes to the range before, to lend its text to the last
    row there (that of the first range to the last range).  Rows alike in a batch become one, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(i, h) for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)]
            copies = np.ones(len(keys), dtype=np.int64)
            if len(set(keys)) < len(keys):
                texts = batch.column("text")
                seen: dict[tuple, int] = {}
                first = [seen.setdefault((k, texts[i].as_py()), i) for i, k in enumerate(keys)]
                copies = np.bincount(first, minlength=len(keys))
                own = np.flatnonzero(copies)
                batch, keys, copies = batch.take(pa.array(own)), [keys[i] for i in own], copies[own]
            ranges = np.array([bisect.bisect_right(starts, k) - 1 for k in keys], dtype=np.int32)
            lenders = [i for i, r in enumerate(ranges) if starts[r] == keys[i]]
            own = _appended(batch, {"copies": pa.array(copies), "fingerprint": pa.array(digests(batch.column("text")), pa.string())})
            yield _appended(own, {"range": pa.array(ranges), "lends": pa.array(np.zeros(len(keys), dtype=bool))})
            if lenders:
                before = pa.array((ranges[lenders] - 1) % len(starts), pa.int32())
                yield _appended(own.take(pa.array(lenders)), {"range": before, "lends": pa.array(np.ones(len(lenders), dtype=bool))})

    return run


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each text's digest beside that of its edited form, whose last quarter gives way to the start of the next document.

    Documents follow each other by ascending id, null ids first, and equal ids by the hash of their texts; behind the last comes
    the first.  Texts are shuffled once, by ranges of ids, and only the first text of each range goes to two of them.  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    starts = _range_starts(save(rows.select("doc_id", "text_hash")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    dealt = rows.mapInArrow(_dealer(starts), _DEALT)
    order = Window.partitionBy("range").orderBy("lends", "doc_id", "text_hash", "text")
    paired = dealt.withColumn("lent", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("lends"))
    # of rows alike, all but the last are followed by their like
    paired = paired.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    alike = F.col("copy") < F.col("copies")
    lent = F.when(alike, F.col("text")).otherwise(F.col("lent"))
    cut = F.expr("cast(n_chars div 4 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(lent, F.lit(1), cut))
    following = F.when(alike, F.col("fingerprint")).otherwise(F.col("next_fingerprint"))
    paired = paired.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", following.alias("next_fingerprint"))
    paired = paired.withColumn("edited_sha256", F.sha2("edited", 256))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, after = batch.column("fingerprint").to_pylist(), batch.column("next_fingerprint").to_pylist()
            edits = digests(batch.column("edited"))
            scores = {"near_edited": pa.array(likenesses(own, edits), pa.float64()), "near_next": pa.array(likenesses(own, after), pa.float64())}
            kept = batch.select(["doc_id", "n_chars", "edited_sha256", "fingerprint"])
            yield _appended(kept, {"edited_fingerprint": pa.array(edits, pa.string()), **scores})

    return paired.mapInArrow(score, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
