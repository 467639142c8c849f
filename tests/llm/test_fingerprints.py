"""Quartile bucket digests against a slow count, and edited texts against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphset.llm import quartile_digest as qd

MASK = (1 << 32) - 1


def bucket(a, b, c, salt):
    h = ((a * int(qd._WEIGHTS[0])) & MASK) ^ ((b * int(qd._WEIGHTS[1])) & MASK) ^ ((c * int(qd._WEIGHTS[2])) & MASK) ^ int(salt)
    h ^= h >> 15
    return ((h * 0x2C1B3C6D) & MASK) >> (32 - (qd.BUCKETS - 1).bit_length())


def slow_digest(text):
    data = (text or "").encode()
    counts = [0] * qd.BUCKETS
    for p in range(len(data)):
        for (i, j), salt in zip(((1, 2), (1, 3), (2, 3)), qd._SALTS, strict=True):
            if p + j < len(data):
                counts[bucket(data[p], data[p + i], data[p + j], salt)] += 1
    order = sorted(counts)
    quartiles = [order[qd.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    bits = "".join(f"{sum(c > q for q in quartiles):02b}" for c in counts)
    return f"{min(255, math.ceil(math.log(len(data) + 1) / math.log(1.1))):02x}{int(bits, 2):0{qd.BUCKETS // 2}x}"


def slow_likeness(a, b):
    x, y = (bin(int(z[2:], 16))[2:].zfill(2 * qd.BUCKETS) for z in (a, b))
    apart = sum(abs(int(x[i : i + 2], 2) - int(y[i : i + 2], 2)) for i in range(0, len(x), 2))
    length = abs(int(a[:2], 16) - int(b[:2], 16))
    return max(0, 1 - 0.9 * min(1, apart / (1.25 * qd.BUCKETS)) - 0.1 * min(1, length / 16))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(1, 9))) for _ in range(n))


TEXTS = [None, "", "a", "ab", "abc", "abcd", "aaaaaaaaaaaaaaaaaa", "é" * 50, *[words(random.Random(i), 3 ** (i % 6)) for i in range(12)]]


def test_digests_and_likeness_equal_slow_ones(monkeypatch):
    want = [slow_digest(t) for t in TEXTS]
    assert qd.digests(pa.array(TEXTS, pa.string())) == want
    monkeypatch.setattr(qd, "PIECE_BYTES", 64)
    assert qd.digests(pa.array(TEXTS, pa.large_string())) == want
    pairs = [(a, b) for a in want for b in want]
    got = qd.likenesses([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [slow_likeness(a, b) for a, b in pairs])
    assert all(0 <= s <= 1 and (s == 1) == (a == b) for s, (a, b) in zip(got, pairs, strict=True))
    assert qd.likenesses([None, want[0], "zz"], [want[0], None, want[0]]) == [None] * 3


def expected(spark, rows):
    hashed = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string").withColumn("h", F.xxhash64("text")).collect()
    docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text, r.doc_id) for r in hashed), key=lambda r: r[:4])
    out = []
    for k, (*_, text, doc_id) in enumerate(docs):
        after, cut = docs[(k + 1) % len(docs)][3], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, following = slow_digest(text), slow_digest(edited), slow_digest(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, round(slow_likeness(own, new), 9), round(slow_likeness(own, following), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_edits_equal_plain_python(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 7, *range(200)]), rng.choice(TEXTS)) for _ in range(n)]
    rows += rows[:5] * 3 + [(7, "same")] * (n // 3)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, range string, fingerprint string").repartition(3)
    got = [(*r[:5], *(round(x, 9) for x in r[5:])) for r in qd.compare_with_edits(docs).collect()]
    assert sorted(got, key=str) == expected(spark, rows)


def test_columns_of_digests(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = qd.with_digests(docs).withColumn("near", qd.likeness(F.col("fingerprint"), F.lit(qd.digest_of("abcd")))).collect()
    assert [r.fingerprint for r in rows if r.text == "abcd"] == [qd.digest_of("abcd")] and all((r.near == 1) == (r.text == "abcd") for r in rows)


def test_edited_texts_stay_near_and_others_do_not(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 200 + i)) for i in range(40)]
    got = qd.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.near_edited > r.near_next for r in got) and min(r.near_edited for r in got) > 0.5
