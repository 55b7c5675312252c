"""Query of the toxicity chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import toxicity
from tradeloom.llm.common import register, table

@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels know one category. The finer ones are toxic documents with more of the
    features that nearly always mean toxicity; a term gives up to three, itself and two stems. They come
    first, and the given one is predicted last, from their probabilities too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = F.col("toxic") == 1
    categories = {"severe": toxic & (F.col("found") >= 15), "repeated": toxic & (F.col("found") >= 6), "toxic": toxic}
    vocabulary, chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories)
    scored = docs.select("doc_id", toxicity.toxicity_column(docs, vocabulary, chain, list(categories)).alias("p"))
    return scored.select("doc_id", F.col("p.toxic").alias("score"), (F.col("p.toxic") >= 0.5).cast("int").alias("predicted"),
                         F.col("p.repeated").alias("p_repeated"), F.col("p.severe").alias("p_severe"))
