"""Reorder alerts, markdown risk and best sellers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.functions.numbers import whole
from tradeloom.sources.roles import has_role
from tradeloom.staging import staged

DS = "dataset_id"
# Rows kept per dataset in the stored analysis.
BEST_SELLERS_KEPT, ALERTS_KEPT, BOTTOM_KEPT = 20, 50, 10


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key. Spark cuts each map partition to k rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def in_reach(df: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """Rows that can be among the k largest of ``value`` per key, so that few are sorted.

    The items of a key are dealt into buckets by hash. The k-th largest of the buckets' maxima is reached by
    k rows at least, so no row below it is among the first k. Where fewer buckets hold a value, all rows
    stay. Reads ``df`` twice; the limits, one row per key, are staged.
    """
    maxima = df.groupBy(*keys, F.pmod(F.xxhash64(item), F.lit(16 * k)).alias("_bucket")).agg(F.max(value).alias("_max"))
    limit = F.get(F.sort_array(F.collect_list("_max"), asc=False), F.lit(k - 1))
    limits = staged(maxima.groupBy(*keys).agg(limit.alias("_limit")), "limits")
    return df.join(limits, keys, "left").where(F.col("_limit").isNull() | (F.col(value) >= F.col("_limit"))).drop("_limit")


def role_value(role: str) -> Column:
    """Cleaned value of a role, NULL only when the sheet has no such column."""
    return F.when(has_role(role), F.coalesce(F.col(role).cast("double"), F.lit(0.0)))


def is_reorder() -> Column:
    stock, cover, st = role_value("stock"), role_value("cover_weeks"), role_value("sell_through")
    fast = (st >= 70) & (stock.isNull() | (stock < 20))
    return F.coalesce(stock == 0, F.lit(False)) | F.coalesce(cover <= 4, F.lit(False)) | F.coalesce(fast, F.lit(False))


def urgency() -> Column:
    stock, cover = role_value("stock"), role_value("cover_weeks")
    return F.when((stock == 0) | (cover <= 1), "CRITICAL").when(cover <= 2, "URGENT").otherwise("REORDER")


def is_markdown() -> Column:
    stock, st = role_value("stock"), role_value("sell_through")
    return F.coalesce((st < 30) & (stock.isNull() | (stock > 0)), F.lit(False))


def severity() -> Column:
    st = role_value("sell_through")
    return F.when(st < 15, "CLEARANCE").when(st < 22, "DEEP").otherwise("TACTICAL")


# Markdown depth recommended per severity, and severity order.
DEPTHS = {"CLEARANCE": "40–50%", "DEEP": "25–35%", "TACTICAL": "15–20%"}
URGENCIES = ["CRITICAL", "URGENT", "REORDER"]


def position(value: Column, words: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(w) for w in words]), value)


def money2(column: str) -> Column:
    return F.round(column, 2).cast("double").alias(column)


def contenders(rollup: DataFrame) -> DataFrame:
    """SKU rows that can be in the best sellers or in one of the two alert lists, as ``in_reach`` finds
    them, but in one pass for all lists. The value compared never falls where revenue rises, so it
    decides for lists that rank unrounded revenue too."""
    marked = rollup.withColumns({"_value": F.round("revenue", 2).cast("double"), "_urgency": F.when(is_reorder(), urgency()),
                                 "_severity": F.when(is_markdown(), severity())})
    kinds = {"_best": (F.lit(True), BEST_SELLERS_KEPT), **{f"_{u}": (F.col("_urgency") == u, ALERTS_KEPT) for u in URGENCIES},
             **{f"_{s}": (F.col("_severity") == s, ALERTS_KEPT) for s in DEPTHS}}
    buckets = 16 * max(k for _, k in kinds.values())
    maxima = marked.groupBy(DS, F.pmod(F.xxhash64("sku"), F.lit(buckets)).alias("_bucket")).agg(
        *[F.max(F.when(kind, F.col("_value"))).alias(name) for name, (kind, _) in kinds.items()])
    limits = staged(maxima.groupBy(DS).agg(*[F.get(F.sort_array(F.collect_list(name), asc=False), F.lit(k - 1)).alias(name)
                                             for name, (_, k) in kinds.items()]), "limits")
    reached = [kind & (F.col(name).isNull() | (F.col("_value") >= F.col(name))) for name, (kind, _) in kinds.items()]
    return marked.join(limits, DS, "left").where(reduce(lambda a, b: a | b, reached)).select(rollup.columns)


def best_sellers(rollup: DataFrame, k: int = BEST_SELLERS_KEPT) -> DataFrame:
    """Top SKUs by revenue."""
    return best_of(in_reach(rollup, [DS], "revenue", "sku", k), k)


def best_of(rollup: DataFrame, k: int = BEST_SELLERS_KEPT) -> DataFrame:
    top = top_per(rollup, [DS], [F.desc("revenue"), F.asc("sku")], k)
    return top.select(
        DS, F.col("rank").cast("int").alias("rank"), "sku", money2("revenue"), whole(F.col("units")).alias("units"),
        "name", "category",
        F.round(role_value("sell_through"), 1).alias("sell_through"),
        F.round("margin_pct", 1).alias("margin_pct"),
        F.bround(role_value("stock"), 0).alias("stock"),
    )


def bottom_sellers(best: DataFrame) -> DataFrame:
    """The slowest of the best sellers by units."""
    ranked = top_per(best.withColumnRenamed("rank", "seller_rank"), [DS], [F.asc("units"), F.asc("seller_rank")], BOTTOM_KEPT)
    return ranked.select(DS, F.col("rank").cast("int").alias("rank"), "sku", "units", "revenue")


def reorder_candidates(rollup: DataFrame) -> DataFrame:
    """Every SKU that needs a reorder, uncut."""
    return rollup.where(is_reorder()).select(
        DS, "sku", urgency().alias("urgency"), money2("revenue"), "name", "category",
        F.bround(role_value("stock"), 0).alias("stock"),
        F.round(role_value("cover_weeks"), 1).alias("cover_weeks"),
        F.round(role_value("sell_through"), 1).alias("sell_through"),
    )


def markdown_candidates(rollup: DataFrame) -> DataFrame:
    """Every SKU at risk of markdown, uncut."""
    sev = severity()
    depth = F.when(sev == "CLEARANCE", DEPTHS["CLEARANCE"]).when(sev == "DEEP", DEPTHS["DEEP"]).otherwise(DEPTHS["TACTICAL"])
    return rollup.where(is_markdown()).select(
        DS, "sku", sev.alias("severity"), F.round(role_value("sell_through"), 1).alias("sell_through"),
        depth.alias("recommended_depth"), money2("revenue"), "name", "category",
    )


def reorder_alerts(rollup: DataFrame, k: int = ALERTS_KEPT) -> DataFrame:
    return reorder_of(in_reach(reorder_candidates(rollup), [DS, "urgency"], "revenue", "sku", k), k)


def reorder_of(candidates: DataFrame, k: int = ALERTS_KEPT) -> DataFrame:
    order = [position(F.col("urgency"), URGENCIES), F.desc("revenue"), F.asc("sku")]
    return top_per(candidates, [DS], order, k).withColumn("rank", F.col("rank").cast("int"))


def markdown_risk(rollup: DataFrame, k: int = ALERTS_KEPT) -> DataFrame:
    return markdown_of(in_reach(markdown_candidates(rollup), [DS, "severity"], "revenue", "sku", k), k)


def markdown_of(candidates: DataFrame, k: int = ALERTS_KEPT) -> DataFrame:
    order = [position(F.col("severity"), list(DEPTHS)), F.desc("revenue"), F.asc("sku")]
    return top_per(candidates, [DS], order, k).withColumn("rank", F.col("rank").cast("int"))
