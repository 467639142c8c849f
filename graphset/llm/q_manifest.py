"""Query of the Merkle manifest, and its SQL: levels are built and climbed by recursion there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.merkle_manifest import verify_documents


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_START = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SHIFT = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),"
    f" lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {_SHIFT})), 4294967295::BIGINT)"
)

SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_START} || {_field("text")}) AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN sha256({_START} || {_field("replace(text, chr(10), '')")}) END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place AS idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, idx // 3),
tops AS (
  SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY idx // 3),
runs AS (SELECT tree, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
top_runs AS (SELECT level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM tops WHERE n > 1 GROUP BY level, idx // 3),
climb AS (
  SELECT tree, place, place AS idx, 0 AS level, coalesce(tampered, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.tree, c.place, c.idx // 3, c.level + 1,
         sha256(array_to_string(r.hs[1:c.idx % 3], '') || c.h || array_to_string(r.hs[c.idx % 3 + 2:], '')),
         c.proof || array_to_string(r.hs[1:c.idx % 3], '') || array_to_string(r.hs[c.idx % 3 + 2:], '')
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 3),
at_source AS (SELECT tree, place, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY tree, place),
climb_top AS (
  SELECT tree, place, tree AS idx, 0 AS level, h, proof FROM at_source
  UNION ALL
  SELECT c.tree, c.place, c.idx // 3, c.level + 1,
         sha256(array_to_string(r.hs[1:c.idx % 3], '') || c.h || array_to_string(r.hs[c.idx % 3 + 2:], '')),
         c.proof || array_to_string(r.hs[1:c.idx % 3], '') || array_to_string(r.hs[c.idx % 3 + 2:], '')
  FROM climb_top c JOIN top_runs r ON r.level = c.level AND r.run = c.idx // 3),
ended AS (SELECT tree, place, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb_top GROUP BY tree, place)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN ended e ON e.tree = p.tree AND e.place = p.place
JOIN nodes s ON s.tree = p.tree AND s.n = 1
JOIN tops t ON t.n = 1
""",
}
