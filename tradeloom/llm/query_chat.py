"""Query of the chat formatting and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import chat
from tradeloom.llm.common import register, table

#: A conversation whose texts hold the template's own control strings.
CLASH = r"\### Assistant: </turn> ok"
_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CLASH}' UNION ALL SELECT -7, 1, 'assistant', '{CLASH}'),
light AS (SELECT *, replace(replace(text, '###', '\h'), '</turn>', '\t') AS once FROM turns),
bodies AS (
  SELECT *, CASE
    WHEN replace(replace(replace(text, '\h', '###'), '\t', '</turn>'), '\e', '\') = text AND NOT contains(text, '###') AND NOT contains(text, '</turn>') THEN text
    WHEN replace(replace(replace(once, '\h', '###'), '\t', '</turn>'), '\e', '\') = text THEN once
    ELSE replace(replace(replace(text, '\', '\e'), '###', '\h'), '</turn>', '\t') END AS body,
    replace(replace(replace(replace(role, '\', '\e'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS mark
  FROM light),
whole AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length(mark) + length(body) + 14) AS size
  FROM bodies GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM whole
"""


@register("op7_chat_format", _SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CLASH).alias("text"))
    made = chat.format_conversations(given.unionByName(extra))
    read = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text().alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
