"""License scan by diagonal voting.

All rolling word k-grams of each text are joined to the positions of license templates; a hit at text word ``pos`` and
template word ``at`` votes for the diagonal ``pos - at``.  Votes are summed per diagonal, neighbouring diagonals are merged
(words put in or left out shift the diagonal), and a span is verified by the share of the template's words it holds.

Short phrases (2-grams) give the base labels: every place where the words of a phrase stand consecutively.  Longer notices
(3-grams) give the labels of the method itself.

Defined cases: a null or empty text has no words, no labels and score 0.  Long texts are scanned whole, in time in
proportion to their length.  Every input row gives one output row, an empty table none; rows alike in id and text are scanned
once and repeated in the result.  A null id stays null.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphset.llm.seeds import gram_rows, hits, seed_table

#: Phrase and label, as the contract fixes them.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Openings of well-known public license notices, and the label of each.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals that lie at most so far apart belong to one span.
BAND = 3
#: Share of a notice's words that a span must hold.
COVERAGE = 0.9


def merge_diagonals(votes: list[tuple[int, list[int]]], k: int, length: int, band: int = BAND) -> float:
    """The largest share of a notice's ``length`` words in one span; votes: (diagonal, text positions of its k-grams).

    Votes are read in the order of the text.  A span takes a vote if its last diagonal is a neighbour; it ends where the
    notice would, so only a few spans are open at a time, and the time is in proportion to the votes.
    """
    best = 0
    spans: list[tuple[int, list[int], set[int]]] = []  # first position, last diagonal, words of the notice
    for at, diagonal in sorted((at, d) for d, places in votes for at in places):
        spans = [s for s in spans if at - s[0] < length + band]
        near = [s for s in spans if abs(diagonal - s[1][0]) <= band]
        if not near:
            near = [(at, [diagonal], set())]
            spans += near
        _, last, words = min(near, key=lambda s: abs(diagonal - s[1][0]))
        last[0] = diagonal
        words.update(range(at - diagonal, at - diagonal + k))
        best = max(best, len(words))
    return best / length


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 for a text with a base phrase, else the largest verified share of a notice, else 0.
    A phrase has two words or more, a notice three or more.
    """
    spark: SparkSession = docs.sparkSession
    tables = []
    for texts, k, start in ((phrases, PHRASE_K, 0), (notices, NOTICE_K, len(phrases))):
        rows = spark.createDataFrame([(start + i, t) for i, (t, _) in enumerate(texts)], "id long, text string")
        tables.append(seed_table(rows, k))
    found = hits(gram_rows(docs, id_col, text_col, (PHRASE_K, NOTICE_K)), tables)
    votes = found.groupBy("key", "text_hash", "passage", F.when(F.col("pos") < 0, F.col("at")).otherwise(F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.when(F.col("pos") >= 0, F.col("pos"))).alias("places"), F.count(F.when(F.col("pos") < 0, 1)).alias("rows")
    )
    whole = votes.groupBy("key", "text_hash").agg(
        F.max(F.when(F.col("passage").isNull(), F.col("diagonal"))).cast("long").alias("n_words"),
        F.sum("rows").cast("int").alias("rows"),
        F.collect_list(F.when(F.col("passage").isNotNull(), F.struct("passage", "diagonal", "places"))).alias("votes"),
    )
    labels = [label for _, label in [*phrases, *notices]]
    lengths = [len(t.split()) for t, _ in [*phrases, *notices]]
    n_phrases = len(phrases)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for votes in batch.column(2).to_pylist():
                starts, base, more, score = [], set(), set(), 0.0
                notices_seen: dict[int, list[tuple[int, list[int]]]] = {}
                for v in votes:
                    p = v["passage"]
                    if p >= n_phrases:
                        notices_seen.setdefault(p, []).append((v["diagonal"], v["places"]))
                    elif len(v["places"]) == lengths[p] - PHRASE_K + 1:
                        starts.append(v["diagonal"])
                        base.add(labels[p])
                for p, seen in notices_seen.items():
                    share = merge_diagonals(seen, NOTICE_K, lengths[p])
                    if share >= coverage:
                        more.add(labels[p])
                        score = max(score, min(share, 1.0))
                out.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", "n_words", "rows", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    done = whole.select("key", "n_words", "votes", "rows").mapInArrow(verify, "key long, n_words long, rows int, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return done.select(F.col("key").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
