"""Rolling word k-grams of whole texts, joined to the positions of a small set of passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphset.llm.common import small
from graphset.llm.words import pieces, signed


def gram_rows(docs: DataFrame, key: str, text: str, ks: tuple[int, ...], kind: str = "alnum") -> DataFrame:
    """A row for each word of each text: key, text_hash, pos, g0, g1, … (the k-gram that begins there, null near the end).

    One more row for each text has pos -1 and the number of words in g0.
    """
    out = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), *((f"g{i}", pa.int64()) for i in range(len(ks)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for a, b, w in pieces(batch.column(1), kind):
                n, own = len(w.hash), keys.slice(a, b - a)
                cols = []
                for i, k in enumerate(ks):
                    at, h = w.grams(k)
                    full = np.zeros(n, dtype=np.int64)
                    full[at] = signed(h)
                    gone = np.ones(n, dtype=bool)
                    gone[at] = False
                    head = w.count.astype(np.int64) if i == 0 else np.zeros(b - a, dtype=np.int64)
                    cols.append(pa.array(np.concatenate([head, full]), mask=np.concatenate([np.full(b - a, i > 0), gone])))
                pos = (np.arange(n) - w.first[w.doc]).astype(np.int32)
                doc = pa.array(np.concatenate([np.arange(b - a), w.doc]))
                cols = [own.take(doc), pa.array(signed(w.text_hash)).take(doc), pa.array(np.concatenate([np.full(b - a, -1, dtype=np.int32), pos])), *cols]
                whole = pa.RecordBatch.from_arrays(cols, schema=out)
                for at in range(0, len(whole), 1 << 17):
                    yield whole.slice(at, 1 << 17)

    schema = "key long, text_hash long, pos int" + "".join(f", g{i} long" for i in range(len(ks)))
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def seed_table(rows: DataFrame, k: int) -> DataFrame:
    """gram -> places (array of (passage, at)) of the k-grams of a few passages (id, text)."""
    grams = gram_rows(rows, "id", "text", (k,)).filter("pos >= 0 AND g0 IS NOT NULL")
    return grams.groupBy(F.col("g0").alias("gram")).agg(F.collect_set(F.struct(F.col("key").alias("passage"), F.col("pos").alias("at"))).alias("places"))


def hits(grams: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """key, text_hash, pos, passage, at: each k-gram that stands in a passage; rows of pos -1 stay, with the words in at."""
    out = grams
    for i, t in enumerate(tables):
        out = out.join(small(t).select(F.col("gram").alias(f"g{i}"), F.when(F.col("places").isNotNull(), F.col("places")).alias(f"p{i}")), f"g{i}", "left")
    found = F.concat(*(F.coalesce(F.col(f"p{i}"), F.array().cast(places_type())) for i in range(len(tables))))
    head = F.array(F.struct(F.lit(None).cast("long").alias("passage"), F.col("g0").cast("int").alias("at")))
    some = F.expr(" OR ".join(["pos < 0", *(f"p{i} IS NOT NULL" for i in range(len(tables)))]))
    return out.filter(some).select("key", "text_hash", "pos", F.explode(F.when(F.col("pos") < 0, head).otherwise(found)).alias("hit")).select("key", "text_hash", "pos", "hit.passage", "hit.at")


def places_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("passage", T.LongType()), T.StructField("at", T.IntegerType())]))
