"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphset.llm import decontaminate as dec
from graphset.llm import html_extract as hx
from graphset.llm import secret_scan as sec
from graphset.llm import toxicity as tox
from graphset.llm.components import components
from graphset.llm.jaccard_join import jaccard_classes
from graphset.llm.license_scan import PHRASES, merge_diagonals, scan_licenses
from graphset.llm.mix_sources import mix_sources
from graphset.llm.pivot_topk import top_k
from graphset.llm.secret_findings import labelled_findings
from graphset.llm.quality import fit_quality, score_quality
from graphset.llm.substring_dedup import remove_repeats, repeated_units
from graphset.llm.words import phrase_words

WORDS = "and the of river stone häuser être open licence wind tree cloud map sea ship lamp door hand book road".split()
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, pos int, n int, id string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    """(doc_id, text, source) rows; the frame has more columns, of names that the operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "x") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (1, None, "a"),
        (2, "", None),
        (3, " \n\t ", "b"),
        (4, base, "a"),
        (5, near, "a"),
        (6, base.upper(), None),
        (7, "three words only", "b"),
        (8, "THREE words only", "b"),
        (8, "THREE words only", "b"),
        (None, "no id here but the MIT License stands", "c"),
        (9, prose(rng, 4000), "c"),
        (10, "Apache  License, Version 2.0 and cc-by, cc by-nc; GNU general public LICENSE " + prose(rng, 30), "a"),
    ]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_word_hashes_depend_on_words_alone():
    a, b = phrase_words("One, two  THREE"), phrase_words("one two-three")
    assert (a == b).all() and len(set(a.tolist())) == 3
    assert phrase_words(None).size == 0 and phrase_words("é", "alnum").size == 1


def test_license_base_columns(table, edge_rows):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(table(edge_rows)).collect())
    want = Counter()
    for i, t, _ in edge_rows:
        w, at, labels = plain_words(t), [], set()
        for p, lab in PHRASES:
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(lab)
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert got == want


def test_license_notices_with_changes(table):
    text = "x Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    r = scan_licenses(table([(1, text, "a"), (2, "is hereby granted free of all care", "a")])).orderBy("doc_id").collect()
    assert r[0].labels == "mit" and r[0].n_base == 0 and 0.9 <= r[0].score <= 1 and r[1].labels == "" and r[1].score == 0
    assert merge_diagonals([(0, [0, 1, 2]), (1, [6, 7])], 3, 9) == 1.0
    assert scan_licenses(table([])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _, _) in enumerate(rows))


def test_jaccard_classes(table, edge_rows):
    rng = random.Random(5)
    rows = list(edge_rows)
    for g in range(6):
        words = prose(rng, 60 + 20 * g).split(" ")
        for k in range(6):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
            # ids repeat and are null, under different texts of equal length
            rows.append(((100 + 10 * g + k if k % 2 else None if g % 2 else 77), " ".join(w), "a"))
    rows += [(None, base, "a") for base in [prose(rng, 50)] * 40] + [(500, prose(rng, 30_000), "a")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(table(rows)).collect())
    assert got == brute_classes(rows)
    assert jaccard_classes(table([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in components(links).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[101] != got[0]


def test_greedy_tiles_on_reordered_passages():
    item = list("abcdefghijklmnop")
    doc = [*item[8:], "x", *item[:8]]
    seeds = [(i, j) for i in range(len(doc) - 3) for j in range(len(item) - 3) if doc[i : i + 4] == item[j : j + 4]]
    assert sorted(dec.greedy_tiles(seeds, 4)) == [(0, 8, 8), (9, 0, 8)]
    assert dec.greedy_tiles([], 4) == []


def test_decontamination(spark, table, edge_rows):
    rng = random.Random(8)
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short"), (None, item)], "item_id long, text string")
    halves = item.split()
    rows = [*edge_rows, (50, "Intro " + item.upper() + " end", "a"), (51, " ".join([*halves[15:], "mid", *halves[:15]]), "a"), (52, " ".join(halves[:9]) + prose(rng, 50), "a")]
    found = dec.tile_benchmark(table(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(50, 1), (50, 2), (51, 1), (51, 2)}
    assert all(r.coverage == 1.0 for r in found) and {r.n_tiles for r in found if r.doc_id == 51} == {2}
    kept = dec.decontaminate(table(rows), bench)
    assert kept.count() == len(rows) - 2 and kept.columns == table(rows).columns


def test_secrets(spark, table):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'é {prose(rng, 10)} token = "{h}" and more', "src") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"call 4{rng.randrange(10**15):015d} or mail joe{i}.x1@mail{i}.example.com or 10.20.30.{i}", "src") for i in range(30)]
    rows += [(200, None, None), (201, "", "a"), (202, "commit " + hexes[0][::-1] + " on main", "test/x")]
    docs = table(rows)
    forest = sec.fit_forest(labelled_findings(spark))
    found = {(r.doc_id, r.start, r.stop) for r in sec.scan_secrets(docs, forest).collect()}
    texts = {i: t for i, t, _ in rows}
    want = {(i, texts[i].index(h), texts[i].index(h) + 40) for i, h in enumerate(hexes)}
    assert want == found  # neither numbers, addresses nor the hash of a commit
    masked = {r.doc_id: r.text for r in sec.redact_secrets(docs, forest).collect()}
    assert len(masked) == len(rows) and masked[200] is None and "[SECRET]" in masked[0] and hexes[0] not in masked[0] and masked[110] == texts[110]
    assert sec.fit_forest(labelled_findings(spark).filter("label = 0")) == [] and sec.scan_secrets(docs, []).count() == 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, []), (2004, [1.0] * 3), (None, [1.0] * 8), (2100, [0.5] * 3), (rows[7][0], rows[7][1]), (7, rows[8][1]), (300, rows[9][1]), (300, rows[300][1])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    whole = [(i, np.floor(np.array(v, dtype=float) * 1024).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, x) in enumerate(whole):
        if q % 100 == 0:
            s = sorted((-int(x @ v), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(x))[:10]
            want += [(q, k + 1, i, -y) for k, (y, i) in enumerate(s)]
    got, want = sorted(got), sorted(want)
    assert got == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_html(spark):
    tree = hx.train_tree(spark)
    page = (
        "<html><head><title>T &amp; t</title><script>if (a < b) x('</p>');</script><style>p{}</style></head><body><!-- <p>no</p> --><nav><a href='/'>Home</a></nav>"
        "<div class='cookie-banner'><p>We use cookies to make this better for you, please agree.</p></div><article><h1>Head &lt;1&gt;</h1><p>First   line\nof <b>bold</b> text<br>here &eacute;&#33;</p>"
        "<form><p>Sign up now for our letter.</p></form><p>Ok.</p></article><section id=comments><p>I liked this very much indeed.</p></section><footer>&copy; me. All rights are reserved.</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (4, "x", "<!-- open <p>gone</p>"), (1, "u", page)]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in hx.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), tree).collect())
    text = "Head <1>\n\nFirst line of bold text here é!\n\nOk."
    assert got == [("1", text, len(text)), ("1", text, len(text)), ("2", "", 0), ("3", "", 0), ("4", "", 0), ("None", got[-1][1], got[-1][2])]
    assert all(hx.is_main(tree, f) == t.startswith("M") for p in hx.LABELLED for t, f in hx.blocks(p))


def test_mix(table, edge_rows):
    rng = random.Random(1)
    rows = [*edge_rows, *((300 + i, prose(rng, rng.randrange(1, 80)), rng.choice(["a", "b", None, "d"])) for i in range(300))]
    got = mix_sources(table(rows)).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size and r.size >= 0
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    want, capped = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s, w in weights.items() if s not in capped and w * level > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s, w in weights.items():
        want[s] = 2 * size[s] if s in capped else w * level
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(r.size for r in got if r.source == s)
    again = Counter((r.doc_id, r.taken) for r in mix_sources(table(rows[::-1])).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    assert mix_sources(table([])).count() == 0 and mix_sources(table([(1, None, "a")])).first().taken == 0


def test_quality_without_labels(table):
    rng = random.Random(6)
    good = [(i, ". ".join(prose(rng, 12).replace("\n", " ").capitalize() for _ in range(8)) + ".", "a") for i in range(120)]
    bad = [(500 + i, " | ".join(rng.choice(WORDS) for _ in range(60)), "a") for i in range(15)] + [(600 + i, "BUY NOW!! " * 40, "a") for i in range(15)]
    docs = table([*good, *bad, (900, None, "a"), (901, "", "a")])
    got = {r.doc_id: r for r in score_quality(docs, fit_quality(docs)).collect()}
    assert sum(got[i].keep for i, _, _ in good) >= 118 and sum(got[i].keep for i, _, _ in bad) <= 1
    assert not got[900].keep and got[901].score == 0.0
    assert score_quality(table([]), fit_quality(table([]))).count() == 0


def test_substring_dedup(table):
    passage = "The old mill by the river was sold last year to a man from the north who meant to live there alone"
    rows = [
        (2, "Own opening here.\n" + passage + "\nOwn end.", "a"),
        (1, passage.upper() + "\nsecond line of this text which nobody else has got", "a"),
        (3, "Pasted in the middle. Start of own words. The wind came up at night and it blew the roof away. Short one. The sea rose over the wall and took the boats along. own tail", "a"),
        (4, "Éa other. The wind came up at night and it blew the roof away! Short one. The sea rose over the wall and took the boats along.", "a"),
        (5, None, "a"),
        (6, "", "a"),
        (7, "Short one.", "a"),
    ]
    spans = repeated_units(table(rows)).collect()
    texts = {i: t for i, t, _ in rows}
    cut = {(r.doc_id, texts[r.doc_id][r.start : r.stop], r.kept_id) for r in spans}
    assert {(r.doc_id) for r in spans} == {2, 4} and (2, passage, 1) in cut
    assert (4, "The wind came up at night and it blew the roof away!", 3) in cut and (4, "Short one.", 3) in cut
    clean = {r.doc_id: r.text for r in remove_repeats(table(rows)).collect()}
    assert clean[2] == "Own opening here.\n\nOwn end." and clean[1] == texts[1] and clean[5] is None and clean[7] == "Short one."
    assert "roof" not in clean[4] and clean[4].startswith("Éa other.") and len(clean) == len(rows)
    assert repeated_units(table([])).count() == 0


def test_toxicity_learns_words_and_pairs(spark, table):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        kind = i % 8
        words = prose(rng, 30).split(" ")
        if kind == 0:
            words[rng.randrange(30)] = rng.choice(["Nasty", "vileword"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(kind == 0)))
    rows += [(1000, None, "a"), (1001, "", "a"), (None, "nasty", "a")]
    frame = spark.createDataFrame([*labels, (0, 1, None), (None, 0, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(table(rows), frame).collect()}
    held = [i for i, _, t in labels if got[i].held_out]
    assert held and all(got[i].predicted == int(i % 8 == 0) for i in held) and not got[1000].predicted and got[None].predicted
    kept = tox.keep_civil(table(rows), tox.fit(table(rows), frame))
    assert kept.columns == table(rows).columns and kept.count() == 350 + 2
    assert tox.toxicity(table(rows[:3]), frame.limit(0)).filter("score = 0.0").count() == 0
    none = tox.toxicity(table(rows[:3]), frame.limit(0)).agg(F.max("score")).first()[0]
    assert none < 1e-100


def test_factorization_machine_scores_pairs():
    m = tox.FactorizationMachine(np.array([1, 2], dtype=np.uint64), 0.0, np.zeros(2), np.array([[2.0], [3.0]]))
    s = m.scores(np.array([0, 1, 1]), np.array([0, 0, 1]), 3)
    assert s[0] == s[2] == 0.5 and s[1] == pytest.approx(1 / (1 + np.exp(-6)))
