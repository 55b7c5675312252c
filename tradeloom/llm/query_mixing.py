"""Query of the mixing and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import mixing
from tradeloom.llm.common import register, table

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM {docs}),
sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(s) OVER () AS total, coalesce(sum(3 * s) OVER before, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
  FROM sources WINDOW before AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min((total - full_before)::DOUBLE / left_w, full_before + s) FILTER (WHERE w * ((total - full_before)::DOUBLE / left_w) <= 3 * s), 0) AS v FROM ordered),
goals AS (SELECT source, s, CASE WHEN w * v > 3 * s THEN (3 * s)::DOUBLE ELSE w * v END AS target FROM sources, level),
budgets AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS whole FROM goals),
pieces AS (SELECT source, h, sum(size)::BIGINT AS g FROM sized WHERE size > 0 GROUP BY source, h),
running AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM pieces),
below AS (
  SELECT r.source, max(h) AS last FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WHERE upto - g / 2.0 <= target - whole * s GROUP BY r.source)
SELECT d.doc_id, d.size, b.s AS source_size, b.target, d.size * (b.whole + CASE WHEN d.h <= l.last THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN below l ON d.source IS NOT DISTINCT FROM l.source
"""


@register("op8_mixing", SQL.replace("{docs}", "documents"))
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
