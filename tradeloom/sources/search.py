"""Search of the catalogue by an index of trigrams instead of a look at every card.

A card is found by what ``workspace_filter`` looks at: its names together, and each of its tags. All
sequences of three characters in these, lower-cased, and each whole tag are its terms. The folder keeps
``cards/v=n/bucket=k``, by a hash of the dataset, and ``postings/v=n/bucket=k`` (term, user_id, dataset_id),
by a hash of the term and sorted by it, so a search reads the lists of its own terms, intersects them,
opens the card buckets of what is left and verifies these cards by ``workspace_filter`` itself.

Every ``add`` is a version. Its cards are written after its postings; it counts when they are complete.
A card's newest version decides: postings of older ones only name candidates that the check refuses. ``columns/v=n`` is an empty table
with the columns of the cards.
A text of fewer than three characters has no trigram and is looked for in all cards, as is an empty one.
Missing names and tags hold no term; a dataset given twice in one ``add`` has to be the same.
One writer at a time; when many versions have come together, a new index is built in a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tradeloom.operators.workspace import DS, workspace_filter
from tradeloom.staging import staged

WIDTH = 3
#: Stands before whole tags, which are terms too.
TAG_MARK = "\0"


def grams(text: Column) -> Column:
    """All sequences of ``WIDTH`` characters of a text."""
    chars = F.split(text, "")
    begin = F.when(F.char_length(text) >= WIDTH, F.sequence(F.lit(0), F.char_length(text) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.transform(begin, lambda i: F.concat(*[F.get(chars, i + k) for k in range(WIDTH)]))


def card_terms() -> Column:
    """Distinct terms of a card."""
    tags = F.transform(F.array_compact(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.lower(t))
    names = F.lower(F.concat_ws(" ", "display_name", "filename"))
    inside = F.flatten(F.transform(F.concat(F.array(names), tags), grams))
    return F.array_distinct(F.concat(inside, F.transform(tags, lambda t: F.concat(F.lit(TAG_MARK), t))))


def wanted_terms(query: str, tag: str) -> list[str]:
    """The terms every card that matches has."""
    query, tag = query.strip().lower(), tag.strip().lower()
    inside = {query[i:i + WIDTH] for i in range(len(query) - WIDTH + 1)}
    return sorted(inside | ({TAG_MARK + tag} if tag else set()))


class WorkspaceIndex:
    """Searchable cards in a folder. ``buckets`` is fixed when the folder is first written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.folder}/cards")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        return sorted(int(e.getPath().getName()[2:]) for e in store.listStatus(top) if store.exists(path(e.getPath(), "_SUCCESS")))

    # ---- writing -----------------------------------------------------------------------

    def add(self, cards: DataFrame, gone: DataFrame | None = None) -> int:
        """Add or replace cards and take away the datasets of ``gone`` (dataset_id); returns the version."""
        version = max(self.versions(), default=-1) + 1
        rows = cards.withColumn("gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(DS, F.lit(True).alias("gone")), allowMissingColumns=True)
        rows = staged(rows, "cards-given")
        terms = rows.where(~F.col("gone")).select(F.explode(card_terms()).alias("term"), "user_id", DS)
        rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/columns/v={version}")
        self._write(terms, "postings", version, "term", ["term", "user_id"])
        self._write(rows, "cards", version, DS, [DS])
        return version

    def _write(self, rows: DataFrame, kind: str, version: int, key: str, order: list[str]) -> None:
        """One shuffle by bucket; a bucket that a frequent term fills is split."""
        spread = rows.withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", F.col("bucket"))
        spread.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/v={version}")

    # ---- reading -----------------------------------------------------------------------

    def _read(self, kind: str) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no index in {self.folder}")
        kept = [f"{self.folder}/columns/v={v}" for v in versions]
        columns = self.spark.read.option("mergeSchema", "true").parquet(*kept).schema
        if kind == "postings":
            columns = StructType([StructField("term", StringType()), columns["user_id"], columns[DS]])
        schema = StructType([*columns.fields, StructField("v", IntegerType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/v={v}" for v in versions])

    def candidates(self, terms: list[str], user: str | None = None) -> DataFrame:
        """Datasets on the lists of all ``terms``."""
        asked = [F.lit(t) for t in terms]
        lists = self._read("postings").where(F.col("bucket").isin([self.bucket(t) for t in asked]) & F.col("term").isin(terms))
        if user is not None:
            lists = lists.where(F.col("user_id") == user)
        return lists.groupBy(DS).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select(DS)

    def search(self, view: str = "active", query: str = "", tag: str = "", user: str | None = None) -> DataFrame:
        """The cards that ``workspace_filter`` gives, of all users or of one."""
        rows, terms = self._read("cards"), wanted_terms(query, tag)
        if terms:
            met = staged(self.candidates(terms, user), "candidates")
            opened = [r[0] for r in met.select(self.bucket(F.col(DS))).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(opened)).join(met, DS, "left_semi")
        columns = [c for c in rows.columns if c not in ("v", "bucket")]
        now = rows.groupBy(DS).agg(F.max_by(F.struct(*columns), "v").alias("card")).select("card.*").where(~F.col("gone")).drop("gone")
        return workspace_filter(now if user is None else now.where(F.col("user_id") == user), view, query, tag)
