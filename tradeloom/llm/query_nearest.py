"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import collision
from tradeloom.llm.common import register, table


@register("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
