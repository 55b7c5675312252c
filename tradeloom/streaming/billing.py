"""Billing events: delivered at least once, folded to the current plan of each profile."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Plan bought with each price; anything else counts as starter.
PRICE_PLANS = {"price_starter": "starter", "price_growth": "growth", "price_studio": "studio"}
#: Groups the ids of a batch are taken in. The first deliveries of a group are held in memory, 98,000 rows at 100 million ids a batch.
BUCKETS = 1024
CHECKOUT = "checkout.session.completed"
UPDATED, DELETED = "customer.subscription.updated", "customer.subscription.deleted"

EVENT_SCHEMA = """id string, type string, created bigint, data struct<object: struct<
    id: string, customer: string, subscription: string, client_reference_id: string, status: string,
    customer_details: struct<email: string>, price_id: string,
    items: struct<data: array<struct<price: struct<id: string>>>>>>"""


def flatten_events(events: DataFrame) -> DataFrame:
    """Webhook JSON as flat columns (batch or stream)."""
    o = lambda f: F.col(f"data.object.{f}")
    bought = F.coalesce(o("price_id"), F.try_element_at(o("items.data"), F.lit(1))["price"]["id"])
    return events.select("id", "type", F.timestamp_seconds("created").alias("ts"), o("customer").alias("customer"),
                         bought.alias("price_id"), o("client_reference_id").alias("reference_id"),
                         o("customer_details.email").alias("email"), o("status").alias("status"))


def scan_billing_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of webhook files, one JSON object per line."""
    return flatten_events(spark.readStream.schema(EVENT_SCHEMA).json(path))


def billing_from_messages(messages: DataFrame) -> DataFrame:
    """The same from a message stream with the JSON in ``value``."""
    return flatten_events(messages.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*"))


def billing_dedup(events: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """First delivery of each event id that has not been processed before."""
    rest = [c for c in events.columns if c != "id"]
    fresh = events if processed is None else events.join(processed.select("id"), "id", "left_anti")
    key = F.struct("ts", "delivery") if "delivery" in events.columns else F.col("ts")
    return fresh.groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("e")).select("id", "e.*")


def billing_dedup_stream(events: DataFrame) -> DataFrame:
    """First delivery of each event id over a stream, however late it comes again.

    Each batch is first reduced to the first delivery of its own ids, many ids in one call; then
    Spark's deduplication looks these up. Its state store keeps the ids, so a batch looks up its own ids only and
    writes the new ones, whatever the number of batches before. State and output are committed together: the ids of a
    batch that failed are not kept, and it is taken again as a whole, also by a new driver.
    """
    order = ["ts", *(["delivery"] if "delivery" in events.columns else [])]

    def first_deliveries(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for rows in chunks:
            both = rows if first is None else pd.concat([first, rows])
            first = both.sort_values(order, kind="stable").drop_duplicates("id")
        yield first

    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    return events.groupBy(bucket).applyInPandas(first_deliveries, events.schema).dropDuplicates(["id"])


def plan_of(price: Column) -> Column:
    rule = F.lit("starter")
    for p, plan in PRICE_PLANS.items():
        rule = F.when(price == p, plan).otherwise(rule)
    return rule


LATEST = ("ts", "id")


def latest_of(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key; partial results combine before the shuffle."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*LATEST)).alias("r")).select(key, "r.*")


def checkouts(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Last checkout of each profile, found by its id, else by e-mail."""
    bought = events.where(F.col("type") == CHECKOUT).select(
        *LATEST, "customer", F.nullif("reference_id", F.lit("")).alias("reference_id"), F.lower("email").alias("email"), plan_of(F.col("price_id")).alias("plan"))
    by_id = bought.where(F.col("reference_id").isNotNull()).select(F.col("reference_id").alias("user_id"), *LATEST, "customer", "plan")
    people = profiles.select("email", "user_id")
    by_mail = bought.where(F.col("reference_id").isNull()).join(people, "email").select("user_id", *LATEST, "customer", "plan")
    return latest_of(by_id.unionByName(by_mail), "user_id")


def subscriptions(events: DataFrame) -> DataFrame:
    """Newest subscription event of each customer."""
    ended = (F.col("type") == DELETED) | (F.col("status") == "canceled")
    moved = events.where(F.col("type").isin(UPDATED, DELETED)).select("customer", *LATEST, F.when(ended, "trial").otherwise(plan_of(F.col("price_id"))).alias("plan"))
    return latest_of(moved, "customer")


def current_plans(profiles: DataFrame, bought: DataFrame, moved: DataFrame) -> DataFrame:
    """user_id, plan and customer. A checkout replaces what is stored; the customer's newest
    subscription event counts if it is later than the checkout, and always for a customer
    known from earlier runs."""
    stored = profiles.select("user_id", F.col("plan").alias("old_plan"), (F.col("customer") if "customer" in profiles.columns else F.lit(None).cast("string")).alias("old_customer"))
    last = bought.select("user_id", F.struct("ts", "customer", "plan").alias("c"))
    newest = moved.select("customer", F.struct("ts", "plan").alias("s"))
    held = stored.join(last, "user_id", "left").withColumn("customer", F.when(F.col("c").isNotNull(), F.col("c.customer")).otherwise(F.col("old_customer")))
    later = F.col("s").isNotNull() & (F.col("c").isNull() | (F.col("s.ts") > F.col("c.ts")))
    return held.join(newest, "customer", "left").select("user_id", F.when(later, F.col("s.plan")).otherwise(F.coalesce("c.plan", "old_plan")).alias("plan"), "customer")


def plan_fold(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Current plan per profile after all events; ``profiles`` may hold a stored ``customer``."""
    return current_plans(profiles, checkouts(events, profiles), subscriptions(events))


class PlanFold:
    """foreachBatch writer that folds billing events across batches.

    Batch n appends its own last checkout per profile and newest subscription event per customer,
    in proportion to its events. They merge in any order and any number of times, so late, repeated
    and replayed events give what a batch over all of them gives; reading merges them.
    ``compact`` sums up what is there, so that reading doesn't grow with the number of batches. All that is
    known lies in the folder: a new driver reads the same plans.
    """

    def __init__(self, folder: str, profiles: DataFrame):
        self.folder, self.profiles = folder, profiles

    def __call__(self, batch: DataFrame, number: int) -> None:
        for name, fresh in (("checkouts", checkouts(batch, self.profiles)), ("subscriptions", subscriptions(batch))):
            fresh.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={number}/{name}")

    def compact(self, spark: SparkSession, through: int) -> None:
        """Sum up the batches up to ``through``, which have all been written, and delete them."""
        for name, (key, rows) in self.states(spark).items():
            rows.where(F.col("batch") <= through).drop("batch").transform(latest_of, key).write.mode("overwrite").parquet(f"{self.folder}/sums/through={through}/{name}")
        folders = self.written(spark)
        for path, kind, number in folders:
            if number < through or kind == "deltas" and number == through:
                filesystem(spark, path).delete(path, True)

    def written(self, spark: SparkSession) -> list[tuple]:
        """(path, kind, number) of all folders whose two tables are complete."""
        out = []
        for kind in ("sums", "deltas"):
            top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            store = filesystem(spark, top)
            for entry in store.listStatus(top) if store.exists(top) else []:
                whole = all(store.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), f"{name}/_SUCCESS")) for name in ("checkouts", "subscriptions"))
                if whole:
                    out.append((entry.getPath(), kind, int(entry.getPath().getName().split("=")[1])))
        return out

    def states(self, spark: SparkSession) -> dict[str, tuple[str, DataFrame]]:
        """Per table its key and rows with the number of their batch: the newest sum and all batches behind it."""
        folders = self.written(spark)
        newest = max((n for _, kind, n in folders if kind == "sums"), default=-1)
        kept = [(path, n) for path, kind, n in folders if kind == "sums" and n == newest or kind == "deltas" and n > newest]
        out = {}
        for name, key in (("checkouts", "user_id"), ("subscriptions", "customer")):
            schema = f"{key} string, ts timestamp, id string, " + ("customer string, plan string" if name == "checkouts" else "plan string")
            number = F.regexp_extract(F.col("_metadata.file_path"), "(?:batch|through)=([0-9]+)/", 1).cast("long")
            paths = [f"{path.toString()}/{name}" for path, _ in kept]
            rows = spark.read.schema(schema).parquet(*paths).withColumn("batch", number) if paths else spark.createDataFrame([], f"{schema}, batch long")
            out[name] = key, rows
        return out

    def plans(self, spark: SparkSession) -> DataFrame:
        """Current plans after all batches written so far."""
        merged = {name: latest_of(rows.drop("batch"), key) for name, (key, rows) in self.states(spark).items()}
        return current_plans(self.profiles, merged["checkouts"], merged["subscriptions"])


def filesystem(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def billing_sink(target: str):
    """foreachBatch writer that stays idempotent: a replayed batch rewrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    return write
