"""Query of the mix of sources, and its SQL: the dual is solved by bisection there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.common import table
from graphset.llm.mix_sources import mix_sources


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}

SQL = {
    "op7_mix_sources": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST((SELECT sum(source_size) FROM sources) AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(weight * (SELECT level FROM levels WHERE weight * level <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1), cap) AS target FROM levels),
groups AS (SELECT source, size, CAST(count(*) AS DOUBLE) AS n, CAST(size AS DOUBLE) AS w FROM sized WHERE size > 0 GROUP BY source, size),
goals AS (
  SELECT t.source, t.target, any_value(t.source_size) / sum(n) AS mean, min(w) AS least, t.target / any_value(t.source_size) AS wanted
  FROM targets t JOIN groups g ON g.source IS NOT DISTINCT FROM t.source WHERE t.target < 2.0::DOUBLE * t.source_size GROUP BY t.source, t.target),
ends AS (SELECT *, (CASE WHEN wanted >= 1 THEN ln(2.0::DOUBLE) ELSE ln(wanted) END) * mean / least AS edge FROM goals),
duals AS (
  SELECT 0 AS k, source, target, mean, least(edge, 0) AS low, greatest(edge, 0) AS high FROM ends
  UNION ALL
  SELECT any_value(d.k) + 1, d.source, any_value(d.target), any_value(d.mean),
         CASE WHEN sum(n * w * least(exp((d.low + d.high) / 2 * w / d.mean), 2)) < any_value(d.target) THEN any_value((d.low + d.high) / 2) ELSE any_value(d.low) END,
         CASE WHEN sum(n * w * least(exp((d.low + d.high) / 2 * w / d.mean), 2)) < any_value(d.target) THEN any_value(d.high) ELSE any_value((d.low + d.high) / 2) END
  FROM duals d JOIN groups g ON g.source IS NOT DISTINCT FROM d.source WHERE d.k < 80 GROUP BY d.source),
rates AS (
  SELECT s.doc_id, s.source, s.size, s.k, t.source_size, t.target,
         CASE WHEN s.size = 0 THEN 1 WHEN t.target >= 2.0::DOUBLE * t.source_size THEN 2 ELSE least(exp((d.low + d.high) / 2 * s.size / d.mean), 2) END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  LEFT JOIN duals d ON d.source IS NOT DISTINCT FROM s.source AND d.k = 80),
parts AS (SELECT *, CAST(round((rate - floor(rate)) * 16777216) AS HUGEINT) AS fraction FROM rates),
runs AS (SELECT *, sum(fraction) OVER (PARTITION BY source ORDER BY size, k ROWS UNBOUNDED PRECEDING) AS run FROM parts)
SELECT doc_id, size, source_size, target,
       CAST((CAST(floor(rate) AS BIGINT) + CAST((run + 8388608) // 16777216 - (run - fraction + 8388608) // 16777216 AS BIGINT)) * size AS BIGINT) AS taken
FROM runs
""",
}
