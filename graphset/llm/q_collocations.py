"""Query of the collocations, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphset.llm.collocations import collocations
from graphset.llm.common import table


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}

SQL = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g
  FROM lists, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, k, g),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.k AS size, c.g, c.a, head, x.a AS l, y.a AS r,
         CAST(1000000::HUGEINT * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM f c, (VALUES (1), (2)) AS places(head)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:head]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[head + 1:]
  WHERE c.k >= 2 AND c.a >= 10 AND head < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, head) = 1),
longer AS (
  SELECT lang, g[1:2] AS g, a FROM f WHERE k = 3 AND a >= 10 UNION ALL SELECT lang, g[2:3], a FROM f WHERE k = 3 AND a >= 10),
covered AS (SELECT lang, g, max(a) AS longer FROM longer GROUP BY lang, g),
kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.g = b.g WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
