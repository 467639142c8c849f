"""Toxicity by a factorization machine over hashed terms.

A term is a word (letters and digits, lower-case), the opening of a longer word, or such an opening that begins so many words
of the text, hashed to 64 bits.  Labelled texts tell which terms go with the label (a likelihood-ratio test over all terms of
the labelled texts); over the presence of all these terms a factorization machine learns a weight for each term and, by the
products of their factors, for each pair of terms.  Every whole text is then scored inside Spark's tasks.

Training reads at most ``max_labelled`` labelled texts (a documented bound; they are taken in the order of a hash of the id),
which bounds the machine: it has no other cap on its terms.

Defined cases: null and empty texts have no terms and get the score of that; long texts are scored whole, in time in
proportion to their length; rows alike get the same score; an id labelled more than once counts as toxic if any of its rows
says so; labels that are null, of a null id or of an unknown id are left out; with no labelled text, or labels of one kind
alone, every score is the share of toxic labels (0 without labels); every input row gives one output row, an empty table
none, and a null id is not held out.  Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphset.llm.common import save
from graphset.llm.words import Words, mix, pieces, signed

#: Labelled texts that training reads at most, factors of a term; rounds, step and regularisation of training.
MAX_LABELLED, FACTORS, ROUNDS, STEP, REG = 20_000, 4, 150, 0.03, 0.003
#: Likelihood ratio (G) from which a term counts as going with the label; 8 is a chance of 1 in 200, which the machine's
#: regularisation has to bear, so that terms of two or three labelled texts count as well.
LEAST_G = 8.0
THRESHOLD = 0.3
#: Bytes of a longer word's opening that make a term, so that endings not seen in training count as well; and in how many
#: words of the text an opening must stand for a further term.
OPENINGS, TIMES = (4, 6, 8), (1, 2, 4)


@dataclass
class FactorizationMachine:
    """The sorted term hashes, the intercept, a weight for each term and its factors."""

    terms: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from distinct pairs (text, place of the term)."""
        raw = np.full(n, self.intercept) + np.bincount(doc, weights=self.linear[term], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            raw += 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def term_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) of all terms of a piece: words, openings of longer words, and openings with which so many words
    of the text begin."""
    doc, hashes = [w.doc], [w.hash]
    for n in OPENINGS:
        at, opening = w.doc[w.size > n], w.openings(n)
        order = np.lexsort((opening, at))
        at, opening = at[order], opening[order]
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (opening[1:] != opening[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(new, len(at)))
        for least in TIMES:
            use = new[times >= least]
            doc.append(at[use])
            hashes.append(mix(opening[use] + np.uint64(least)))
    d, h = np.concatenate(doc), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])) if len(d) else np.zeros(0, dtype=bool)
    return d[new], h[new]


def present(words: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in ``terms``) of a piece."""
    if not len(terms):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc, hashes = term_hashes(words)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[at] == hashes
    return doc[hit], at[hit]


def term_sets(labelled: DataFrame) -> DataFrame:
    """y, terms (distinct term hashes) of labelled (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in pieces(batch.column(1), "alnum"):
                doc, hashes = term_hashes(w)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                sets = [signed(hashes[ends[i] : ends[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["y", "terms"])

    return labelled.select(F.col("y").cast("double"), F.col("text").cast("string")).mapInArrow(run, "y double, terms array<long>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, least_g: float = LEAST_G, factors: int = FACTORS) -> FactorizationMachine:
    """The machine over all terms that go with the label in at most ``max_labelled`` labelled texts."""
    marked = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("label_id").agg(F.max("y").alias("y"))
    taken = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    # at most max_labelled rows of two numbers: the bound of what is broadcast
    sets = save(term_sets(texts.join(F.broadcast(taken), "label_id")))
    n, pos = sets.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = pos / n if n else 0.0
    none = np.zeros(0, dtype=np.uint64), float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share else -700.0), np.zeros(0), np.zeros((0, factors))
    if not 0 < pos < n:
        return FactorizationMachine(*none)
    counts = sets.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    seen = F.col("a") + F.col("b")
    g = 2 * sum((part(x, y) for x, y in ((F.col("a"), seen * share), (F.col("b"), seen * (1 - share)), (pos - F.col("a"), (n - seen) * share), (n - pos - F.col("b"), (n - seen) * (1 - share)))), F.lit(0.0))
    # no cap: these are terms of at most max_labelled texts that few terms become by chance
    best = counts.filter("a + b >= 2").withColumn("g", g).filter(F.col("g") >= least_g).select("term").collect()
    if not best:
        return FactorizationMachine(*none)
    terms = np.sort(np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64))
    known = np.sort(terms.view(np.int64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[str(t) for t in x[np.isin(x, known)]] for x in (np.array(r, dtype=np.int64) for r in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "found"])

    place = CountVectorizerModel.from_vocabulary([str(t) for t in terms.view(np.int64).tolist()], inputCol="found", outputCol="features")
    rows = save(sets.select("y", "terms").mapInArrow(keep, "label double, found array<string>"))
    model = FMClassifier(factorSize=factors, maxIter=ROUNDS, stepSize=STEP, regParam=REG, solver="adamW", seed=7).fit(place.transform(rows).select("label", "features"))
    return FactorizationMachine(terms, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score and predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in pieces(batch.column(1), "alnum"):
                score = model.scores(*present(w, model.terms), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["id", "score"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text scores below the threshold, with all their columns."""

    names, kinds = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in pieces(batch.column(at), "alnum"):
                yield batch.slice(a, b - a).filter(pa.array(model.scores(*present(w, model.terms), b - a) < threshold))

    return docs.mapInArrow(run, kinds)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labels of ids that are not held out, score all: id, held_out, score, predicted."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), **options)
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
