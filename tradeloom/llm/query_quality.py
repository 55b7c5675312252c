"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.llm import quality
from tradeloom.llm.common import register, table


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Column:
    """The score column for ``docs``, learnt from the labelled documents of the folder."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return quality.score_column(docs, quality.train(table(spark, sf_dir, "documents"), labels))


@register("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_scores(spark, docs, sf_dir).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
