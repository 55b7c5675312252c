"""Category cards, top sellers, slow movers and recommended actions for every category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradeloom.functions.money import fixed
from tradeloom.functions.templates import render
from tradeloom.operators.alerts import top_per
from tradeloom.operators.health import category_health_score
from tradeloom.staging import staged

# The sentences this module puts into results are given wording, word for word.

DS = "dataset_id"
# Lines listed per category.
LISTED = 5


def category_cards(categories: DataFrame) -> DataFrame:
    st, mg = F.col("avg_sell_through"), F.col("avg_margin_pct")
    return categories.where(F.col("revenue") > 0).select(
        DS, "category", "revenue", "units", "sku_count", st.alias("sell_through"), mg.alias("margin"),
        category_health_score(st, mg).alias("health"), F.col("health").alias("health_label"))


def low(column: str = "category"):
    return F.lower(F.col(column)).alias("cat_key")


def category_top_sellers(best: DataFrame) -> DataFrame:
    """Largest lines of each category among the stored best sellers."""
    members = best.where(F.col("category").isNotNull()).withColumnRenamed("rank", "seller_rank").withColumn("cat_key", F.lower("category"))
    return top_per(members, [DS, "cat_key"], [F.desc("revenue"), F.asc("seller_rank")], LISTED).select(
        DS, "cat_key", F.col("rank").cast("int").alias("rank"), "sku", F.coalesce("name", "sku").alias("name"),
        "revenue", "units", "sell_through", "margin_pct", "stock")


def category_slow_movers(best: DataFrame, markdown: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Lines with the lowest sell-through that are not among the category's top sellers (``top``, if
    they are known already).

    Markdown rows come first, completed from the best sellers; categories without any
    fall back to their remaining best sellers. Both kinds are taken away the top sellers once, and a
    window over the category, which the ranking needs anyway, tells which kind counts.
    """
    top = (category_top_sellers(best) if top is None else top).select(DS, "cat_key", "sku")
    columns = ["category", "sku", "name", "revenue", "units", "sell_through", "margin_pct", "stock", "rank", "kind"]
    extra = best.select(DS, "sku", F.col("name").alias("b_name"), "units", "margin_pct", "stock")
    marked = markdown.join(extra, [DS, "sku"], "left").withColumns({"name": F.coalesce("name", "b_name"), "units": F.coalesce("units", F.lit(0)), "kind": F.lit(1)})
    rest = best.where(F.col("sell_through").isNotNull()).withColumn("kind", F.lit(2))
    rows = marked.select(DS, *columns).unionByName(rest.select(DS, *columns)).where(F.col("category").isNotNull()).withColumn("cat_key", F.lower("category"))
    rows = rows.join(top, [DS, "cat_key", "sku"], "left_anti").withColumn("first_kind", F.min("kind").over(Window.partitionBy(DS, "cat_key")))
    slow = rows.where(F.col("kind") == F.col("first_kind")).select(
        DS, "cat_key", "sku", F.coalesce("name", "sku").alias("name"), "revenue", "units", "sell_through", "margin_pct", "stock", F.col("rank").alias("seq"))
    order = [F.asc_nulls_last("sell_through"), F.asc("seq")]
    return top_per(slow, [DS, "cat_key"], order, LISTED).drop("seq").withColumn("rank", F.col("rank").cast("int"))


def category_actions(categories: DataFrame, slow: DataFrame) -> DataFrame:
    """Recommended actions per category."""
    weakest = slow.where(F.col("rank") == 1).select(DS, "cat_key", F.struct("name", "sell_through").alias("weakest"))
    df = categories.withColumn("cat_key", F.lower("category")).join(weakest, [DS, "cat_key"], "left")
    f = F.col
    st, mg, line = f("avg_sell_through"), f("avg_margin_pct"), f("weakest.sell_through")
    entry = lambda kind, template, **fields: F.struct(F.lit(kind).alias("type"), render(template, **fields).alias("text"))
    rules = F.array_compact(F.array(
        F.when(st < 30, entry("Markdown", "Clear ageing {c} stock — {st}% sell-through signals weak demand; "
                              "a 20–30% markdown releases working capital.", c=f("category"), st=fixed(st, 0))),
        F.when(st >= 45, entry("Reorder", "Lean into {c} — {st}% sell-through is outpacing supply; "
                               "increase buying depth before stockouts.", c=f("category"), st=fixed(st, 0))),
        F.when(mg < 40, entry("Margin", "Protect {c} margin — at {m}% it sits below the 40% benchmark; "
                              "review cost prices and discount depth.", c=f("category"), m=fixed(mg, 0))),
        F.when((line != 0) & (line < 25), entry("Review", "{n} is the weakest line at {st}% — consider markdown or delisting.",
                                                n=f("weakest.name"), st=fixed(line, 0))),
    ))
    calm = F.array(entry("Monitor", "{c} is trading in line with the range — monitor weekly and hold current strategy.", c=f("category")))
    chosen = F.when(F.size(rules) == 0, calm).otherwise(rules)
    return df.select(DS, "category", F.posexplode(chosen).alias("pos", "a")).select(
        DS, "category", (F.col("pos") + 1).alias("pos"), "a.type", "a.text")


def listing(rows: DataFrame, name: str) -> DataFrame:
    """SKUs of at most five ranked rows as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sku")))
    return rows.groupBy(DS, "cat_key").agg(F.array_join(F.transform(ordered, lambda s: s["sku"]), ",").alias(name))


def category_detail(categories: DataFrame, best: DataFrame, markdown: DataFrame) -> DataFrame:
    """One row per category: card, top sellers, slow movers, kinds of action."""
    top = staged(category_top_sellers(best), "top-sellers")
    slow = staged(category_slow_movers(best, markdown, top), "slow-movers")
    kinds = category_actions(categories, slow).groupBy(DS, "category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda s: s["type"]), ",").alias("actions"))
    st, mg = F.col("avg_sell_through"), F.col("avg_margin_pct")
    cards = categories.select(DS, "category", F.lower("category").alias("cat_key"), "revenue", "units", "sku_count",
                              st.alias("sell_through"), mg.alias("margin"), category_health_score(st, mg).alias("health"),
                              F.col("health").alias("health_label"))
    out = cards.join(listing(top, "top_sellers"), [DS, "cat_key"], "left").join(
        listing(slow, "slow_movers"), [DS, "cat_key"], "left").join(kinds, [DS, "category"], "left")
    return out.drop("cat_key").fillna("", ["top_sellers", "slow_movers"])
