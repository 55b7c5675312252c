"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import secrets
from tradeloom.llm.common import register, table


@register("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.corpus_samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    counts = [F.size(secrets.of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))
