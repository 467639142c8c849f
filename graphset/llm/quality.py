"""Quality by weak labels.

Overlapping heuristic labellers look at each whole text and vote good (1), bad (0) or abstain (2).  Expectation-maximisation
over the counts of all vote patterns in the corpus (at most 3 to the number of labellers) estimates how often each labeller
is right on good and on bad texts, without any label; the posterior of each pattern then labels texts softly, and a linear scorer over hashed terms is
trained on them by logistic regression.  The scorer judges every whole text.

Counts of patterns cover all texts.  The scorer's training reads about ``max_train`` texts (a documented bound), chosen by
a hash of their bytes.

Defined cases: null and empty texts have no words; their only vote is bad.  Long texts are judged whole; rows alike get the
same score; every input row gives one output row; a null id stays null; an empty table gives an empty result.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.llm.common import save
from graphset.llm.words import KINDS, Words, mix, pieces

#: Texts that the scorer is trained on, about; buckets of the hashed terms.
MAX_TRAIN, BUCKETS = 8_000, 1 << 13
GOOD, BAD, NONE = 1, 0, 2
#: Labellers: feature, vote, and the range in which it votes that way (else it abstains).  Fixed values.
LABELLERS = [
    ("words", BAD, 0, 4),
    ("symbol_share", BAD, 0.15, 1.0),
    ("letter_share", BAD, 0.0, 0.65),
    ("lone_symbols", BAD, 0.1, 1e9),
    ("symbols_per_word", BAD, 0.25, 1e9),
    ("upper_share", BAD, 0.4, 1.0),
    ("words_per_stop", BAD, 0.0, 1.5),
    ("repeat_share", BAD, 0.1, 1.0),
    ("distinct_share", BAD, 0.0, 0.25),
    ("word_length", BAD, 0.0, 2.5),
    ("word_length", BAD, 14.0, 1e9),
    ("prose", GOOD, 1, 1),
]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def lone_symbols(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many stretches without white space hold neither a letter nor a digit: bullets, bars, separators."""
    solid = KINDS["solid"][data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(solid & (np.append(True, ~solid[:-1])[: len(data)] | edge[:-1]))
    end = np.flatnonzero(solid & (np.append(~solid[1:], True)[: len(data)] | edge[1:])) + 1
    plain = np.concatenate([[0], np.cumsum(KINDS["alnum"][data])])
    lone = start[plain[end] == plain[start]]
    return np.bincount(np.searchsorted(bounds, lone, side="right") - 1, minlength=len(bounds) - 1).astype(float)


def features(w: Words, data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text of a piece."""
    n_bytes = np.maximum(np.diff(bounds), 1)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    plain = letter | ((data >= 48) & (data <= 57)) | np.isin(data, np.frombuffer(b" \t\r\n.,;:!?'\"()-", dtype=np.uint8))
    words = np.maximum(w.count, 1)
    again = np.zeros(len(w.hash), dtype=bool)
    if len(w.hash):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), dtype=bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    n = len(bounds) - 1
    distinct = np.bincount(d[new], minlength=n)
    stops = _per_text(np.isin(data, np.frombuffer(b".!?", dtype=np.uint8)), bounds)
    out = {
        "words": w.count.astype(float),
        "symbol_share": _per_text(~plain, bounds) / n_bytes,
        "lone_symbols": lone_symbols(data, bounds) / words,
        "upper_share": _per_text(upper, bounds) / np.maximum(_per_text(letter, bounds), 1),
        "repeat_share": np.bincount(w.doc[again], minlength=n) / words,
        "distinct_share": distinct / np.sqrt(words * np.minimum(words, 200)),
        "word_length": _per_text(letter, bounds) / words,
        "letter_share": _per_text(letter, bounds) / n_bytes,
        "symbols_per_word": _per_text(~plain, bounds) / words,
        "words_per_stop": np.where(stops > 3, w.count / np.maximum(stops, 1), 10.0),
    }
    calm = (out["symbol_share"] < 0.04) & (out["upper_share"] < 0.15) & (out["repeat_share"] < 0.03) & (out["words_per_stop"] < 60)
    out["prose"] = (calm & (out["word_length"] > 3) & (out["word_length"] < 9) & (w.count > 4)).astype(float)
    return out


def votes(seen: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each text, as a number in base 3."""
    out = np.zeros(len(seen["words"]), dtype=np.int64)
    for name, vote, at, to in LABELLERS:
        x = seen[name]
        v = np.where((x >= at) & (x <= to), vote, NONE)
        if name != "words":
            v[seen["words"] == 0] = NONE
        out = out * 3 + v
    return out


def each_piece(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    texts = batch.column(column).fill_null("")
    for a, b, w in pieces(texts, "alnum"):
        own = texts.slice(a, b - a)
        kind = np.int64 if pa.types.is_large_string(own.type) else np.int32
        bounds = np.frombuffer(own.buffers()[1], dtype=kind)[own.offset : own.offset + b - a + 1].astype(np.int64)
        data = np.frombuffer(own.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]] if own.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        yield a, b, w, data, bounds - bounds[0]


def fit_labellers(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good texts, how often each labeller votes bad, good or not at all on (bad, good) texts, and the posterior
    of good for each pattern."""
    m = len(LABELLERS)
    codes = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[int(c)] for c in codes], dtype=float)
    v = np.stack([codes // 3 ** (m - 1 - j) % 3 for j in range(m)], axis=1)
    bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
    post = (good + 0.5) / (good + 2 * bad + 1.0)  # a start from the mere votes
    prior, rates = 0.5, np.zeros((2, m, 3))
    for _ in range(rounds):
        prior = float(np.clip((post * weight).sum() / weight.sum(), 0.01, 0.99))
        for c, p in ((BAD, (1 - post) * weight), (GOOD, post * weight)):
            for x in range(3):
                # half a text of each kind keeps rates off 0
                rates[c, :, x] = (((v == x) * p[:, None]).sum(axis=0) + 0.5) / (p.sum() + 1.5)
        log = np.log([1 - prior, prior]) + np.stack([np.log(rates[c][np.arange(m), v]).sum(axis=1) for c in (BAD, GOOD)], axis=1)
        post = 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -700, 700)))
    return prior, rates, {int(c): float(p) for c, p in zip(codes, post, strict=True)}


def hashed_terms(w: Words, data: np.ndarray, bounds: np.ndarray, seen: dict[str, np.ndarray], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value): shares of the words by hash, of single bytes that are no letters, and of repeated words."""
    n = len(bounds) - 1
    again = np.zeros(len(w.hash), dtype=bool)
    if len(w.hash):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    odd = np.flatnonzero((data < 48) | ((data > 57) & (data < 97)) | ((data > 122) & (data < 128)))
    odd = odd[~np.isin(data[odd], np.frombuffer(b" \t\r\n", dtype=np.uint8))]
    odd_doc = np.searchsorted(bounds, odd, side="right") - 1
    terms = np.concatenate([w.hash, mix(data[odd].astype(np.uint64) + np.uint64(1)), np.full(int(again.sum()), np.uint64(77), dtype=np.uint64)])
    doc = np.concatenate([w.doc, odd_doc, w.doc[again]])
    key, counts = np.unique(doc.astype(np.int64) * buckets + (terms % np.uint64(buckets)).astype(np.int64), return_counts=True)
    d = key // buckets
    return d, key % buckets, np.sqrt(counts / np.maximum(np.bincount(doc, minlength=n), 1)[d])


@dataclass
class QualityModel:
    prior: float
    rates: np.ndarray
    posterior: dict[int, float]
    weights: np.ndarray
    intercept: float


def fit_quality(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> QualityModel:
    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, data, bounds in each_piece(batch, 0):
                code, n = np.unique(votes(features(w, data, bounds)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    texts = docs.select(F.col(text_col).cast("string"))
    counts = {r["code"]: r["n"] for r in texts.mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    prior, rates, posterior = fit_labellers(counts) if counts else (0.5, np.full((2, len(LABELLERS), 3), 1 / 3), {})
    share = min(1.0, max_train / max(1, sum(counts.values())))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, data, bounds in each_piece(batch, 0):
                seen = features(w, data, bounds)
                code = votes(seen)
                take = mix(w.text_hash).astype(float) / 2.0**64 < share
                d, bucket, value = hashed_terms(w, data, bounds, seen)
                ends = np.searchsorted(d, np.arange(len(code) + 1))
                rows = [(posterior[int(code[i])], bucket[ends[i] : ends[i + 1]].astype(np.int32), value[ends[i] : ends[i + 1]]) for i in np.flatnonzero(take)]
                if rows:
                    p, b, v = zip(*rows, strict=True)
                    m = len(rows)
                    sparse = pa.StructArray.from_arrays([pa.array(np.zeros(m, dtype=np.int8)), pa.array(np.full(m, BUCKETS, dtype=np.int32)), pa.array(b, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float64()))], ["type", "size", "indices", "values"])
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), sparse], names=["p", "features"])

    # the file holds vectors as the fields that they are made of
    vectors = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("features", VectorUDT())])
    rows = save(texts.mapInArrow(train, "p double, features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"), vectors)
    both = rows.select(F.lit(1.0).alias("label"), F.col("p").alias("weight"), "features").union(rows.select(F.lit(0.0), 1 - F.col("p"), "features")).filter("weight > 0.001")
    if len({r[0] for r in both.select("label").distinct().collect()}) < 2:
        return QualityModel(prior, rates, posterior, np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    model = LogisticRegression(weightCol="weight", regParam=0.0005, maxIter=60).fit(both)
    return QualityModel(prior, rates, posterior, model.coefficients.toArray(), float(model.intercept))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score (0 to 1, higher: better), weak (the posterior of the labellers' votes) and keep for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, data, bounds in each_piece(batch, 1):
                seen = features(w, data, bounds)
                d, bucket, value = hashed_terms(w, data, bounds, seen)
                raw = model.intercept + np.bincount(d, weights=model.weights[bucket] * value, minlength=b - a)
                score = np.where(w.count == 0, 0.0, 1 / (1 + np.exp(-np.clip(raw, -700, 700))))
                weak = [model.posterior.get(int(c), model.prior) for c in votes(seen)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(weak, pa.float64())], names=["id", "score", "weak"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, score double, weak double")
    return scored.select(F.col("id").alias(id_col), "score", "weak", (F.col("score") >= threshold).alias("keep"))
