"""Query of the n-gram join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import ngram_join
from tradeloom.llm.common import register, table


@register("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).withColumnRenamed("id", "doc_id")
