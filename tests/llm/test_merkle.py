"""The Merkle manifest against a recursive one in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from graphset.llm import merkle_manifest as merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, idx int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def climb(nodes, at, hashed):
    """(root, siblings, root from ``hashed`` at ``at``)."""
    siblings = ""
    while len(nodes) > 1:
        run = at // 3 * 3
        left, right = "".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])
        siblings, hashed = siblings + left + right, H(left, hashed, right)
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], siblings, hashed


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    roots = [climb([leaf(r, r[1]) for r in own[s]], 0, "")[0] for s in order]
    out = []
    for k, s in enumerate(order):
        nodes = [leaf(r, r[1]) for r in own[s]]
        for i, r in enumerate(own[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            other = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            sub, first, up = climb(nodes, i, other)
            root, second, folded = climb(roots, k, up)
            out.append((r[0], nodes[i], sub, root, H(first + second), folded, folded == root))
    return sorted(out, key=str)


def rows_of(sizes):
    rng = random.Random(5)
    texts = [None, "", "a\nb", "\n", "plain", "é\nü 漢", "long " * 20_000 + "\n"]
    rows = []
    for source, n in sizes.items():
        rows += [(rng.choice([None, *range(-3, 400)]), rng.choice(texts), rng.choice([None, "en", "dé"]), source, rng.choice([None, 0, 7]), "x", 1, 2) for _ in range(n)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 260, "b": 81, "é": 82, "Z": 3, None: 30, "": 4}, {f"s{i}": 1 + i % 3 for i in range(90)}])
def test_manifest_equals_a_recursive_one(spark, sizes):
    rows = rows_of(sizes)
    got = merkle.verify_documents(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_manifest_of_no_rows_is_empty(spark):
    assert merkle.verify_documents(spark.createDataFrame([], COLUMNS)).count() == 0


def test_only_every_few_levels_are_stored(spark):
    rows = rows_of({"a": 100})
    leaves = spark.createDataFrame(rows, COLUMNS).select("source", "doc_id", merkle.leaf_digest().alias("leaf"))
    manifest = merkle.build_manifest(leaves)
    assert [level.count() for level in manifest.leaves.levels] == [102, 2]
    assert merkle.manifest_proofs(manifest).filter(merkle.fold(merkle.F.col("hash"), merkle.F.col("steps")) != merkle.F.col("root")).count() == 0
