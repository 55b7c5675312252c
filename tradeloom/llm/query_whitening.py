"""Query of the embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import whitening
from tradeloom.llm.common import register, table


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4).withColumnRenamed("id", "vec_id")
