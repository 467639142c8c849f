"""The pipeline's stages on null, empty, repeated and long rows, against what each has to do to them."""

from __future__ import annotations

import random
import uuid
from collections import Counter

import pytest

import corpus_pipeline
from graphset.llm.common import save

KEY = "ghp_1a2B3c4D5e6F7g8H9i0J1k2L3m4N5o6P7q8R"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables of documents, labels and benchmark, made by hand."""
    path = str(tmp_path_factory.mktemp(f"sf{uuid.uuid4().hex[:6]}"))
    rng = random.Random(31)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, prose(40) + (" vileword" if i % 6 == 0 else ""), "en", f"s{i % 4}") for i in range(120)]
    base = prose(60)
    item = " ".join(f"q{i}" for i in range(25))
    rows += [(200, base, "en", "s0"), (201, base, "en", "s1"), (202, base + " tail", None, "s1"), (None, base, "en", None), (203, base, "en", "s0"), (203, base, "en", "s0")]
    rows += [(300, None, None, None), (None, None, "en", "s1"), (301, "", "en", "s2"), (301, "", "en", "s2"), (None, " ", None, None)]
    rows += [(400, "intro " + item + " end " + prose(20), "en", "s1"), (None, item + prose(3), "en", "s1"), (400, prose(30), "en", "s1"), (401, f"my key is {KEY} here " + prose(10), "en", "s3"), (500, prose(20_000), "en", "s2")]
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_does_its_work_and_leaves_the_rest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = save(stage(spark, docs, sf_dir))
        got = Counter(map(tuple, out.collect()))
        assert out.columns == columns, name
        if name == "toxicity":
            want = Counter({r: n for r, n in rows.items() if "vileword" not in (r[1] or "")})
        elif name == "ngram_jaccard_join":
            # of the copies of one text, and what is nearly it, the row of the least id stays; empty texts are no copies
            copies = [r for r in rows if r[0] in (200, 201, 202, 203) or (r[0] is None and r[1] and len(r[1]) > 150 and "q1" not in r[1].split())]
            want = Counter({r: n for r, n in rows.items() if r not in copies})
            want[min((r for r in copies if r[0] is not None), key=lambda r: r[0])] = 1
        elif name == "benchmark_decontamination":
            want = Counter({r: n for r, n in rows.items() if " q7 q8 q9 " not in (r[1] or "")})
        else:
            want = Counter()
            for r, n in rows.items():
                t = None if r[1] is None else r[1].replace(KEY, "[SECRET]")
                want[r[0], t, r[2], r[3], None if t is None else len(t)] += n
        assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3])
        docs, rows = out, got
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(mixed) <= sum(rows.values()) and all(1 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mixed)
    kept = Counter(tuple(r[c] for c in columns) for r in mixed)
    assert not kept - rows


def test_an_empty_table_passes_through(spark, sf_dir):
    docs = save(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and set(docs.columns) <= set(out.columns), name
