"""Corpus pipeline: documents to a mix of sources, in five stages.

1. quality: documents that the classifier scores below 0.5 go.
2. line dedup: lines found in at least 10 documents are dropped; a null text stays null, a
   text that loses all its lines stays as an empty one, ``n_chars`` follows the text.
3. n-gram join: of the documents connected by a similarity of 0.8 or more, the one with the
   smallest doc_id stays. Rows of one doc_id are one document and stay or go together.
4. decontamination: contaminated documents go, all others are left as they are.
5. mixing: how many words each document gives to the mix.

Each stage works on all rows its predecessor kept. All but the last return the columns they
were given, whatever these are called; an empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality, query_quality
from tradeloom.llm.common import spare, table
from tradeloom.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~query_quality.held_out())
    forest = quality.train(docs, labels)
    return docs.where(quality.score_column(docs, forest) >= 0.5)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = line_dedup.frequent_line_filters(docs, min_docs=10, min_chars=1)
    found = spare(docs, "found")
    marked = line_dedup.drop_lines(docs, filters, found)
    changed = F.coalesce(F.col(f"{found}.n_dropped") > 0, F.lit(False)) & F.col("text").isNotNull()
    new = {"text": F.col(f"{found}.kept"), "n_chars": F.char_length(f"{found}.kept").cast("long")}
    return marked.select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = spare(docs, "stays")
    kept = ngram_join.near_duplicates(docs).where(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias(stays))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(stays)), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = spare(docs, "found")
    marked = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), found)
    return marked.where(~decontaminate.is_contaminated(found)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_frequent_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: A trained classifier can't be written in SQL; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
