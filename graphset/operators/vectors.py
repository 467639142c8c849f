"""Token corpora, word vectors and graph vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCA, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.operators.alike import once
from graphset.operators.fingerprint import dedup_environments, identifiers, sentences
from graphset.operators.skipgram import train_skip_gram
from graphset.operators.tables import drop_invalid
from graphset.sources.text import feature_columns, read_graph_text
from graphset.storage import BROADCAST_BYTES, BROADCAST_ROWS, is_small, save, small

#: Bits of a Bloom filter for each token, and tokens of which one is made at most, so that it has at most BROADCAST_BYTES.
FILTER_BITS = 16
FILTER_ROWS = 8 * BROADCAST_BYTES // FILTER_BITS


def token_counts(tokens: DataFrame) -> DataFrame:
    """token, n over all sentences (gid, tokens)."""
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a Bloom filter may hold."""
    places = _places(hashes, 8 * len(bits))
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Four places of each 64-bit hash in a filter of ``size`` bits."""
    h = hashes.view(np.uint64)
    return np.stack([((h & 0xFFFFFFFF) + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) % np.uint64(size) for i in range(4)]).astype(np.int64)


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of the tokens of (token, n)."""
    # at most FILTER_ROWS hashes
    hashes = frequent.select(F.xxhash64("token").alias("h")).toArrow().column("h").to_numpy()
    bits = np.zeros(max(64, 8 * -(-len(hashes) * FILTER_BITS // 8)), dtype=bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits, bitorder="little")


def _false_positives(rare: DataFrame, bits: np.ndarray) -> DataFrame:
    """token of those of (token, n) that the filter takes for frequent; a written table."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["token"]).filter(pa.array(_in_filter(bits, batch.column(1).to_numpy())))

    return save(rare.select("token", F.xxhash64("token").alias("h")).mapInArrow(pick, "token string"))


def _most_frequent(frequent: DataFrame) -> pa.Array:
    """The tokens of (token, n), a written table, from the highest counts down, as many as can be sent to all executors; counts
    of one size go together."""
    size = F.floor(F.log2("n") * 8).cast("int")
    # a few hundred sizes at most
    sizes = frequent.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("token"), F.lit(0))).alias("bytes")).orderBy(F.desc("size")).collect()
    least, rows, length = None, 0, 0
    for r in sizes:
        rows, length = rows + r.rows, length + r.bytes
        if rows > BROADCAST_ROWS or length > BROADCAST_BYTES:
            break
        least = r["size"]
    few = frequent.filter(size >= least).select("token").collect() if least is not None else []
    return pa.array([r.token for r in few], pa.string())


def _doubtful(tokens: DataFrame, known: pa.Array) -> DataFrame:
    """gid, token of the tokens of (gid, tokens) that are not among ``known``, once for each sentence; null ones are left out."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            rest = pc.and_(pc.is_valid(words), pc.invert(pc.is_in(words, value_set=known)))
            once = pa.table({"row": pa.array(row).filter(rest), "token": words.filter(rest)}).group_by(["row", "token"]).aggregate([]).combine_chunks()
            yield from pa.table({"gid": batch.column(0).take(once.column("row").combine_chunks()), "token": once.column("token")}).to_batches()

    return tokens.select("gid", "tokens").mapInArrow(pick, T.StructType([tokens.schema["gid"], T.StructField("token", T.StringType())]))


def insert_unk(tokens: DataFrame, threshold: int = 3, unk: str = "UNK") -> DataFrame:
    """Tokens that occur at most ``threshold`` times in all become ``unk``; order stays.

    Where the frequent tokens are few enough to be sent to all executors, sentences are rewritten where they lie; so they are
    with up to ``FILTER_ROWS`` of them, of which a Bloom filter is sent, with the rare tokens that it takes for frequent, so
    that no token is mistaken.  Beyond, the most frequent ones are sent; only a sentence's other tokens, each once, meet the
    frequent ones in a join, and those that are unknown come back to the sentence, which is shuffled once.  Sentences without
    tokens are left out.
    """
    tokens = tokens.filter(F.size("tokens") > 0)
    counts = save(token_counts(tokens))
    frequent = save(counts.filter(F.col("n") > threshold))

    def rewritten(lists: pa.ListArray, out: pa.Array) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), out)

    schema = T.StructType([tokens.schema["gid"], T.StructField("tokens", T.ArrayType(T.StringType()))])
    if is_small(frequent):
        # at most BROADCAST_ROWS of them
        known = pa.array([r.token for r in frequent.select("token").collect()], pa.string())

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(1).flatten()
                yield pa.RecordBatch.from_arrays([batch.column(0), rewritten(batch.column(1), pc.if_else(pc.is_in(words, value_set=known), words, unk))], names=["gid", "tokens"])

        return tokens.select("gid", "tokens").mapInArrow(rewrite, schema)
    if frequent.count() <= FILTER_ROWS:
        bits = _filter_of(frequent)
        false = _false_positives(counts.filter(F.col("n") <= threshold), bits)
        if is_small(false):
            # at most BROADCAST_ROWS of them
            rare = pa.array([r.token for r in false.collect()], pa.string())

            def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    words = batch.column(1).flatten()
                    known = pc.and_(pa.array(_in_filter(bits, batch.column(2).flatten().to_numpy())), pc.invert(pc.is_in(words, value_set=rare)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), rewritten(batch.column(1), pc.if_else(known, words, unk))], names=["gid", "tokens"])

            return tokens.select("gid", "tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")).mapInArrow(test, schema)
    null_known = not frequent.filter("token IS NULL").isEmpty()
    rare = _doubtful(tokens, _most_frequent(frequent)).join(frequent.select("token"), "token", "left_anti")
    rare = rare.groupBy(F.col("gid").alias("of")).agg(F.collect_set("token").alias("rare"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten()
            # a token is rare in all sentences or in none
            gone = pc.is_in(words, value_set=pc.unique(batch.column(2).flatten()))
            if not null_known:
                gone = pc.or_(gone, pc.is_null(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), rewritten(batch.column(1), pc.if_else(gone, unk, words))], names=["gid", "tokens"])

    met = tokens.select("gid", "tokens").join(rare, F.col("gid").eqNullSafe(F.col("of")), "left")
    return met.select("gid", "tokens", "rare").mapInArrow(replace, schema)


def train_word2vec(tokens: DataFrame, size: int = 100, window: int = 10, min_count: int = 3, iterations: int = 1, partitions: int = 1, seed: int = 42) -> Word2VecModel:
    """Skip-gram vectors of Spark ML, where partitions train apart and are averaged; ``train_skip_gram`` needs no averages."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, numPartitions=partitions, seed=seed, inputCol="tokens", outputCol="mean").fit(tokens)


def sentence_vectors(tokens: DataFrame, vectors: DataFrame, unseen: str | None = None) -> DataFrame:
    """gid, vector: the sum of the vectors (token, vector) of a sentence's tokens.  Unseen tokens take the vector of the
    token ``unseen``, or are skipped; a sentence without any has a zero vector."""
    dims = vectors.select(F.size("vector")).first()
    size = dims[0] if dims else 0
    at = tokens.select("gid", F.explode_outer("tokens").alias("token"))
    if unseen is not None:
        known = small(vectors.select("token", F.lit(True).alias("known")))
        at = at.join(known, "token", "left").withColumn("token", F.when(F.col("known"), F.col("token")).when(F.col("token").isNotNull(), F.lit(unseen))).drop("known")
    # vectors are sent to the sentences, where those that occur are few enough, so sums of whole vectors are not shuffled
    words = small(vectors.join(at.select("token").distinct(), "token", "left_semi"))
    used = at.groupBy("gid", "token").agg(F.count("*").alias("n")).join(words, "token", "left")
    sums = used.groupBy("gid").agg(*(F.coalesce(F.sum(F.col("n") * F.col("vector")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(size)))
    return sums.select("gid", F.array(*(F.col(f"d{i}") for i in range(size))).cast("array<double>").alias("vector"))


def join_features(rows: DataFrame, features: DataFrame, key: str = "gid") -> DataFrame:
    """Features joined back to their rows by key; a row without features has nulls."""
    return rows.join(features, key, "left")


def featurize(rows: DataFrame, v: DataFrame, e: DataFrame, vectors: DataFrame, radius: int = 1, unseen: str | None = "UNK", prefix: str = "feature-") -> DataFrame:
    """``rows`` (gid and more columns) with the columns ``prefix`` 000, 001, … of their graphs' vectors: invalid rows (null
    gid) go, graphs become sentences of neighbourhood identifiers, sentences the sums of their words' vectors."""

    def features(v: DataFrame, e: DataFrame) -> DataFrame:
        return sentence_vectors(sentences(dedup_environments(save(identifiers(v, e, radius)), v, e)), vectors, unseen)

    return feature_columns(join_features(drop_invalid(rows, "gid"), once(v, e, features)), prefix=prefix)


def featurize_file(spark: SparkSession, source: str, target: str, vectors: DataFrame, **options) -> None:
    """Graph text in, features as CSV out."""
    v, e = read_graph_text(spark, source)
    v, e = save(v), save(e)
    featurize(v.select("gid").distinct(), v, e, vectors, **options).write.option("header", True).csv(target)


def mean_vector(df: DataFrame, by: list[str], column: str = "vector") -> DataFrame:
    """by…, pos, mean: the mean of vectors, dimension by dimension."""
    return df.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def running_vectors(df: DataFrame, by: str, order: str, column: str = "vector") -> DataFrame:
    """Start points of vectors laid end to end inside each group: sums inside ranges of rows, then over the ranges, so a large
    group is not one task's work."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = save(df.select(by, order, column).repartitionByRange(parts, by, order).withColumn("range", F.spark_partition_id()))
    at = dealt.select(by, order, "range", F.posexplode(column).alias("pos", "x"))

    def running(x: str, *keys: str, along: str):
        return F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    sums = at.groupBy(by, "range", "pos").agg(F.sum("x").alias("sum"))
    before = sums.withColumn("before", running("sum", by, "pos", along="range")).drop("sum")
    own = at.withColumn("own", running("x", by, "range", "pos", along=order))
    return own.join(before, [by, "range", "pos"]).select(by, order, "pos", (F.col("before") + F.col("own")).alias("start"))


def project_2d(df: DataFrame, column: str = "vector") -> DataFrame:
    """Rows with x and y, the first two principal components."""
    rows = df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    out = PCA(k=2, inputCol="features", outputCol="plane").fit(rows).transform(rows).withColumn("plane", vector_to_array("plane"))
    return out.withColumns({"x": F.col("plane")[0], "y": F.col("plane")[1]}).drop("features", "plane")


class _GraphVecParams(Params):
    """What the estimator and its model share."""

    size = Param(Params._dummy(), "size", "dimensions of a word's vector", TypeConverters.toInt)
    window = Param(Params._dummy(), "window", "words of context on either side", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "occurrences from which a word gets a vector", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "occurrences up to which a token is taken for the unknown one", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "passes over all pairs of words", TypeConverters.toInt)
    blocks = Param(Params._dummy(), "blocks", "blocks of the vocabulary, as many as tasks train at once", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the first vectors and of the draws", TypeConverters.toInt)
    unk = Param(Params._dummy(), "unk", "the token for unknown ones", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(size=100, window=10, minCount=3, threshold=3, iterations=5, blocks=4, seed=42, unk="UNK")


class GraphVec(Estimator, _GraphVecParams, DefaultParamsReadable, DefaultParamsWritable):
    """Word vectors over sentences (gid, tokens), with rare tokens as ``unk``; its model sums them per graph."""

    @keyword_only
    def __init__(self, *, size: int = 100, window: int = 10, minCount: int = 3, threshold: int = 3, iterations: int = 5, blocks: int = 4, seed: int = 42, unk: str = "UNK"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, tokens: DataFrame) -> GraphVecModel:
        known = insert_unk(tokens, self.getOrDefault("threshold"), self.getOrDefault("unk"))
        options = {name: self.getOrDefault(name) for name in ("size", "window", "iterations", "blocks", "seed")}
        return self._copyValues(GraphVecModel(train_skip_gram(save(known), min_count=self.getOrDefault("minCount"), **options)))

    def fit_transform(self, tokens: DataFrame) -> DataFrame:
        return self.fit(tokens).transform(tokens)

    def transform(self, tokens: DataFrame) -> DataFrame:
        raise ValueError("fit before transform")


class _GraphVecWriter(MLWriter):
    def __init__(self, model: GraphVecModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.words.write.parquet(f"{path}/words")


class _GraphVecReader(MLReader):
    def load(self, path: str) -> GraphVecModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GraphVecModel(self.sparkSession.read.parquet(f"{path}/words"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class GraphVecModel(Model, _GraphVecParams, MLReadable, MLWritable):
    """gid and vector of each sentence: the sum of its words' vectors, unknown ones as ``unk`` if that has a vector."""

    def __init__(self, words: DataFrame):
        super().__init__()
        self.words = words

    def vectors(self) -> DataFrame:
        return self.words

    def _transform(self, tokens: DataFrame) -> DataFrame:
        unk = self.getOrDefault("unk")
        known = not self.words.filter(F.col("token") == unk).isEmpty()
        return sentence_vectors(tokens, self.words, unk if known else None)

    def write(self) -> MLWriter:
        return _GraphVecWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _GraphVecReader()
