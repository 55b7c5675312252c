"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import language
from tradeloom.llm.common import register, table
from tradeloom.llm.query_quality import held_out


@register("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return language.predict(docs, language.train(docs, ~held_out()), keep=("doc_id", "held_out"))
