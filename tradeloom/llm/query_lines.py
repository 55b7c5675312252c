"""Query of the line dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import line_dedup
from tradeloom.llm.common import ASCII_LOWER, ASCII_UPPER, register, table

_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ASCII_UPPER}', '{ASCII_LOWER}') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN often.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY doc_id
"""


@register("op9_line_dedup", _SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    filters = line_dedup.frequent_line_filters(docs, min_docs=10, min_chars=1)
    found = line_dedup.drop_lines(docs, filters)
    return found.select("doc_id", "found.n_lines", "found.n_dropped", F.sha2(F.col("found.kept"), 256).alias("kept_sha256"))
