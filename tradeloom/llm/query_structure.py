"""Query of the conversation repair and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import structure
from tradeloom.llm.common import register, table

#: CRC-32 of conversation and turn, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""


def _answer(edit: str, cost: str, behind: str, line: str = "") -> str:
    """An answer is (cost, audit, repaired lines), so the least is the cheapest and then ASCII-least."""
    lines = f"list_prepend({line}, {behind}.r)" if line else f"{behind}.r"
    return f"{{'c': {behind}.c + {cost}, 'a': '{edit}' || {behind}.a, 'r': {lines}}}"


def _taken(state: int, behind: int, role: str, system: bool = False) -> str:
    """The best that takes row x in a grammar state whose next row has to be ``role``'s."""
    late, own = "(x.fault = 't')::BIGINT", "x.role || ':' || x.text"
    keep = f"WHEN x.i = '{role[0]}' THEN {_answer('K', late, f'v.c{behind}', own)}" + (f" WHEN x.i = 's' THEN {_answer('K', late, 'v.c1', own)}" if system else "")
    rerole = _answer("R", f"2 + {late}", f"v.c{behind}", f"'{role}:' || x.text")
    return f"CASE WHEN x.fault IN ('b', 'd') THEN {_answer('D', '3', f'v.c{state}')} ELSE least({_answer('D', '3', f'v.c{state}')}, {rerole}, CASE {keep} END) END AS t{state}"


_BEFORE_USER, _BEFORE_ASSISTANT = (f"least(t2, {_answer('I', '2', 't3', chr(39) + 'assistant:' + chr(39))})", f"least(t3, {_answer('I', '2', 't2', chr(39) + 'user:' + chr(39))})")
_SQL = f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS d FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) FROM given WHERE d <> 0),
ordered AS (
  SELECT *, left(role, 1) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
rows_ AS (
  SELECT *, CASE WHEN z = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before,
         dense_rank() OVER (ORDER BY conv_id NULLS LAST) AS g FROM ordered),
steps AS (
  SELECT DISTINCT g, n AS k, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS c0, {{'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS c1,
         {{'c': 2::BIGINT, 'a': 'I', 'r': ['assistant:']}} AS c2, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS c3 FROM rows_
  UNION ALL
  SELECT g, k, least(t0, {_answer('I', '2', 'b2', chr(39) + 'user:' + chr(39))}), least(t1, {_answer('I', '2', 'b2', chr(39) + 'user:' + chr(39))}), b2, b3
  FROM (SELECT *, {_BEFORE_USER} AS b2, {_BEFORE_ASSISTANT} AS b3
        FROM (SELECT v.g, v.k - 1 AS k, {_taken(0, 2, 'user', True)}, {_taken(1, 2, 'user')}, {_taken(2, 3, 'assistant')}, {_taken(3, 2, 'user')}
              FROM steps v JOIN rows_ x ON v.g = x.g AND v.k = x.k))),
found AS (
  SELECT any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate,
         count_if(fault = 't')::BIGINT AS truncated, count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, g FROM rows_ GROUP BY g)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s.c0.c, 0) AS cost, coalesce(s.c0.a, '') AS audit, sha256(coalesce(array_to_string(s.c0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN found f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN steps s ON s.g = f.g AND s.k = 0
"""


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): each row dropped, emptied, stripped of its marks, repeated or
    given to the user, or left as it is, by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(code == 4, "user").otherwise(spaced("role"))
    twice = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), (code == 0).alias("gone"), twice).drop("copy")


@register("op13_structure", _SQL)
def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return structure.repair(rows).withColumnRenamed("conv", "conv_id")
