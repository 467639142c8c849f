"""Counting quotient filters against plain counters, and collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from graphset.llm import collocations as col
from graphset.llm import quotient_filter as qf


@pytest.mark.parametrize(("high", "low", "section"), [(1, 1, 0), (3, 3, 3), (10, 20, 4), (20, 40, 11), (32, 64, 12), (64, 64, 9), (22, 44, 0)])
def test_filters_keep_every_key_and_count(high, low, section):
    rng = np.random.default_rng(high)
    w = qf.Widths(high, low, section)

    def some(bits, n):
        return rng.integers(0, 1 << min(bits, 62), n, dtype=np.uint64) << np.uint64(max(0, bits - 62))

    shards, truth = [], Counter()
    for n in (0, 1, 500, 3000):
        a, b = some(high, n), some(low, n)
        a, b = np.append(a, np.repeat(a[:3], 400)), np.append(b, np.repeat(b[:3], 400))
        truth.update(zip(a.tolist(), b.tolist(), strict=True))
        shards.append(qf.pack(qf.counted(a, b, w), w))
    out = Counter()
    for s in {s for shard in shards for s, _ in shard}:
        total = qf.merged([qf.unpack(s, data, w) for shard in shards for t, data in shard if t == s], w)
        assert (np.diff(total.high.astype(object)) >= 0).all()
        a, b = w.restore(total.high, total.low)
        got = dict(zip(zip(a.tolist(), b.tolist(), strict=True), total.count.tolist(), strict=True))
        assert len(got) == len(total) and not set(got) & set(out)
        out.update(got)
    assert out == truth


def test_filters_are_small():
    rng = np.random.default_rng(1)
    w = qf.Widths(18, 18, 6)
    ids = rng.integers(1, 1 << 18, 200_000, dtype=np.uint64)
    packed = qf.pack(qf.counted(ids[:-1], ids[1:], w), w)
    assert sum(len(d) for _, d in packed) < 4.6 * len(ids)


def expected(rows, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in frequent.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= cover * a for h, b in frequent.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "ÉA", "x-y", "漢字", "a b", "new", "york", "city", *[f"w{i}" for i in range(30)]]
    glue = [" ", "  ", "\t", ". ", ",", "\n", "! ", "\x0b", "; "]
    weights = [60, 2, 2, 2, 2, 2, 1, 1, 1]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "new york city" for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        text = "".join(w + rng.choices(glue, weights)[0] for w in words)
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice([None, "und", "en", "en", "dé"])))
    return [*rows, *rows[:4], ("long phrase here. " * 5_000, "long")]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, shard int, word string").repartition(3)
    got = col.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shard", [1 << 23, 300])
def test_collocations_equal_plain_python(spark, monkeypatch, shard):
    monkeypatch.setattr(col, "SHARD_BYTES", shard)
    monkeypatch.setattr(col, "GATHERED", 1 << 23 if shard > 300 else 50)
    rows = corpus(120, shard)
    assert result(spark, rows) == expected(rows) and len(expected(rows)) > 50


def test_top_and_bounds_of_collocations(spark):
    rows = corpus(60, 9)
    assert result(spark, rows, least=3, cover=80, top=7) == expected(rows, 3, 80, 7)


def test_collocations_without_frequent_phrases(spark):
    assert result(spark, []) == [] and result(spark, [(None, None), ("", "en"), (" . ", "en"), ("one two three", None)]) == []
