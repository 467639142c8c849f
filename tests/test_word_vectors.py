"""Skip-gram over blocks: pairs against plain Python, neighbours of planted words, equal reruns, and pipelines that are saved."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from graphset.operators import skipgram, vectors

TOPICS = [[f"{t}{i}" for i in range(6)] for t in "abcd"]


def corpus(spark, n=400):
    rng = random.Random(1)
    rows = [(g, [rng.choice(TOPICS[g % 4]) if rng.random() < 0.95 else "noise" for _ in range(12)]) for g in range(n)]
    return spark.createDataFrame([*rows, (9_000, []), (9_001, ["lone"]), (9_002, None)], "gid long, tokens array<string>")


def test_pairs_equal_plain_python(spark):
    tokens = corpus(spark, 30)
    words = skipgram.vocabulary(tokens, 3, 3)
    of = {r.id: r.token for r in words.collect()}
    want, counts = Counter(), Counter(t for r in tokens.collect() for t in r.tokens or [])
    for r in tokens.collect():
        line = [t for t in r.tokens or [] if counts[t] >= 3]
        for i, w in enumerate(line):
            for j, c in enumerate(line):
                if 0 < abs(i - j) <= 4:
                    want[w, c] += (4 - abs(i - j) + 1) / 4
    got = {(of[r.w], of[r.c]): r.n for r in skipgram.pair_counts(tokens, words, 4).collect()}
    assert set(of.values()) == {t for t, n in counts.items() if n >= 3} and got == pytest.approx(dict(want))


def test_planted_words_are_neighbours_and_reruns_agree(spark):
    tokens = corpus(spark)
    found = [{r.token: np.array(r.vector) for r in skipgram.train_skip_gram(tokens.repartition(n), size=12, window=5, iterations=6, blocks=3, rate=0.05).collect()} for n in (2, 5)]
    a, b = found
    assert a.keys() == b.keys() and all(np.array_equal(a[t], b[t]) for t in a) and len(a) == 25
    unit = {t: x / np.linalg.norm(x) for t, x in a.items()}
    right = 0
    for topic in TOPICS:
        for t in topic:
            near = sorted((o for o in unit if o != t), key=lambda o: -unit[o] @ unit[t])[:5]
            right += len(set(near) & set(topic))
    assert right >= 0.9 * 4 * 6 * 5


def test_model_is_kept_inside_a_pipeline(spark, tmp_path):
    tokens = corpus(spark, 80)
    stages = [SQLTransformer(statement="SELECT * FROM __THIS__ WHERE gid IS NOT NULL"), vectors.GraphVec(size=6, window=3, threshold=37, iterations=1, blocks=2, unk="rare")]
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    plan = Pipeline.load(str(tmp_path / "plan"))
    assert plan.getStages()[1].getOrDefault("unk") == "rare" and plan.getStages()[1].getOrDefault("threshold") == 37
    model = plan.fit(tokens)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.stages[1].getOrDefault("unk") == "rare"
    new = spark.createDataFrame([(1, ["a0", "never seen"]), (2, []), (3, ["never seen"])], "gid long, tokens array<string>")
    rows = [{r.gid: r.vector for r in m.transform(new).collect()} for m in (model, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    rare = {r.token: r.vector for r in again.stages[1].vectors().collect()}["rare"]
    assert rows[0][3] == rare and rows[0][2] == [0.0] * 6
    with pytest.raises(ValueError, match="fit before"):
        vectors.GraphVec().transform(new)


def test_a_corpus_without_frequent_words(spark):
    assert skipgram.train_skip_gram(spark.createDataFrame([(1, ["a", "b"])], "gid long, tokens array<string>"), size=4).count() == 0


def test_meetings_are_few_and_weigh_what_pairs_count():
    n, draw = np.array([0.2, 3.0, 31.4, 1e9]), np.random.default_rng(1)
    total, times = np.zeros(4), np.zeros(4)
    for here, weight in skipgram.meetings(n, draw):
        total[here] += weight
        times[here] += 1
    assert total == pytest.approx(n) and list(times) == [1, 3, 32, 32]


def test_a_corpus_repeated_very_often_is_learned_as_well(spark, monkeypatch):
    counts = skipgram.pair_counts
    monkeypatch.setattr(skipgram, "pair_counts", lambda *a: counts(*a).withColumn("n", F.col("n") * 100_000))
    found = skipgram.train_skip_gram(corpus(spark), size=12, window=5, iterations=3, blocks=2, rate=0.05).collect()
    unit = {r.token: np.array(r.vector) / np.linalg.norm(r.vector) for r in found}
    near = {t: sorted((o for o in unit if o != t), key=lambda o: -unit[o] @ unit[t])[:5] for t in unit}
    assert sum(len(set(near[t]) & set(topic)) for topic in TOPICS for t in topic) >= 0.9 * 4 * 6 * 5


def test_pairs_are_the_same_by_either_way(spark, monkeypatch):
    tokens = corpus(spark, 30).unionByName(spark.createDataFrame([(9_100 + i, [None, "a0", None, "a1"]) for i in range(3)], "gid long, tokens array<string>"))
    words = skipgram.vocabulary(tokens, 3, 3)
    here = skipgram.pair_counts(tokens, words, 4)
    assert "posexplode" not in here._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, here.collect()))
    monkeypatch.setattr(skipgram, "is_small", lambda _: False)
    assert sorted(map(tuple, skipgram.pair_counts(tokens, words, 4).collect())) == want and want
