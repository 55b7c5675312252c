"""Comparison of two datasets: KPIs, categories, SKUs.

``pairs(a, b)`` names the comparisons; every operator runs for all pairs at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.money import fixed, pounds
from tradeloom.functions.numbers import percent_of
from tradeloom.functions.templates import render
from tradeloom.operators.alerts import top_per
from tradeloom.operators.health import with_health

# The sentences this module puts into results are given wording, word for word.

DS = "dataset_id"
# Category moves shown per comparison.
MOVES_KEPT = 25
KPI_METRICS = {"revenue": "total_revenue", "units": "total_units", "margin": "avg_margin_pct",
               "sell_through": "avg_sell_through", "reorders": "reorder_count", "health": "health"}
ENTITY_METRICS = ["revenue", "units", "sell_through", "margin"]


def side(pairs: DataFrame, table: DataFrame, which: str) -> DataFrame:
    """Rows of one side of each pair with columns suffixed ``_a`` or ``_b``."""
    keys = pairs.select("a", "b")
    rows = keys.join(table, keys[which] == table[DS]).drop(DS)
    return rows.select("a", "b", *[F.col(c).alias(f"{c}_{which}") for c in table.columns if c != DS])


def metric_rows(names: list[str], a: str = "{}_a", b: str = "{}_b") -> Column:
    """Long form: one struct (metric, a, b, diff, pct) per metric."""
    structs = []
    for n in names:
        x, y = F.col(a.format(n)).cast("double"), F.col(b.format(n)).cast("double")
        structs.append(F.struct(F.lit(n).alias("metric"), x.alias("value_a"), y.alias("value_b"),
                                (y - x).alias("diff"), percent_of(y - x, x).alias("pct")))
    return F.inline(F.array(*structs))


def rounded_moves(df: DataFrame) -> DataFrame:
    return df.withColumn("diff", F.round("diff", 4)).withColumn("pct", F.round("pct", 4))


def kpi_sides(pairs: DataFrame, kpis: DataFrame) -> DataFrame:
    scored = with_health(kpis).select(DS, "margin_available", *[F.col(c).alias(n) for n, c in KPI_METRICS.items()])
    return side(pairs, scored, "a").join(side(pairs, scored, "b"), ["a", "b"])


def compare_datasets(pairs: DataFrame, kpis: DataFrame) -> DataFrame:
    return rounded_moves(kpi_sides(pairs, kpis).select("a", "b", metric_rows(list(KPI_METRICS))))


def presence(a: str, b: str) -> Column:
    return F.when(F.col(a).isNull(), "new").when(F.col(b).isNull(), "dropped").otherwise("changed")


def both_sides(pairs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Full outer match of a table's two sides on its key."""
    marked = table.withColumn("here", F.lit(1))
    a = side(pairs, marked, "a").withColumnRenamed(f"{key}_a", key)
    b = side(pairs, marked, "b").withColumnRenamed(f"{key}_b", key)
    return a.join(b, ["a", "b", key], "full_outer").withColumn("status", presence("here_a", "here_b"))


def compare_categories(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    cats = categories.select(DS, "category", "revenue", F.col("avg_sell_through").alias("st"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both_sides(pairs, cats, "category").select(
        "a", "b", "category", "status", zero("revenue_a").alias("rev_a"), zero("revenue_b").alias("rev_b"),
        F.round(zero("revenue_b") - zero("revenue_a"), 2).alias("rev_diff"), zero("st_a").alias("st_a"), zero("st_b").alias("st_b"))


def category_movement_top(moves: DataFrame) -> DataFrame:
    order = [F.desc(F.abs("rev_diff")), F.asc("category")]
    return top_per(moves, ["a", "b"], order, MOVES_KEPT).withColumn("rank", F.col("rank").cast("int"))


def sku_index(best: DataFrame, markdown: DataFrame, reorder: DataFrame) -> DataFrame:
    """One record per SKU pooled from the three stored tables, earlier tables first."""
    fields = {"revenue": "double", "units": "double", "sell_through": "double", "margin_pct": "double",
              "stock": "double", "name": "string", "category": "string"}
    pick = lambda df, src: df.select(DS, "sku", F.lit(src).alias("src"), *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    pool = reduce(DataFrame.unionByName, [pick(best, 1), pick(markdown, 2), pick(reorder, 3)])
    present = lambda c, t: F.col(c).isNotNull() & (F.col(c) != "") if t == "string" else F.col(c).isNotNull()
    out = pool.groupBy(DS, "sku").agg(*[F.min_by(c, F.when(present(c, t), F.col("src"))).alias(c) for c, t in fields.items()])
    return out.withColumnRenamed("margin_pct", "margin")


def compare_entities(pairs: DataFrame, index: DataFrame, key: str, label: bool = True) -> DataFrame:
    """Metric moves of every SKU or category of either side, in long form."""
    matched = both_sides(pairs, index, key)
    newest = lambda c: F.when(F.col("here_b").isNotNull(), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    name = F.coalesce(newest("name"), F.col(key)) if label else F.col(key)
    category = newest("category") if label else F.col(key)
    return rounded_moves(matched.select("a", "b", F.col(key).alias("entity"), "status", name.alias("name"),
                                        category.alias("category"), metric_rows(ENTITY_METRICS)))


def compare_skus(pairs: DataFrame, index: DataFrame) -> DataFrame:
    return compare_entities(pairs, index, "sku")


def compare_category_entities(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    index = categories.select(DS, "category", "revenue", F.col("units").cast("double").alias("units"),
                              F.col("avg_sell_through").alias("sell_through"), F.col("avg_margin_pct").alias("margin"), "sku_count")
    return compare_entities(pairs, index, "category", label=False)


def union_skus(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """SKUs of either side, once each."""
    keys = index.select(DS, "sku")
    pick = lambda which: pairs.join(keys, pairs[which] == keys[DS]).select("a", "b", "sku")
    return pick("a").union(pick("b")).distinct()


def compare_commentary(pairs: DataFrame, kpis: DataFrame, categories: DataFrame) -> DataFrame:
    """Up to four sentences per comparison with their tone."""
    moves = compare_categories(pairs, categories)
    biggest = lambda sign, name: top_per(moves.where(F.signum("rev_diff") == sign), ["a", "b"],
                                         [F.desc(F.abs("rev_diff")), F.asc("category")], 2).groupBy("a", "b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda s: s["category"]), ", ").alias(name))
    df = kpi_sides(pairs, kpis).join(biggest(1, "up"), ["a", "b"], "left").join(biggest(-1, "down"), ["a", "b"], "left")
    f = F.col
    d = lambda m: f(f"{m}_b") - f(f"{m}_a")
    word = lambda m, yes, no: F.when(d(m) >= 0, yes).otherwise(no)
    pct = percent_of(d("revenue"), f("revenue_a"))
    signed_pct = F.when(pct.isNotNull(), F.concat(F.lit(" ("), F.when(pct >= 0, "+").otherwise(""), fixed(pct, 1), F.lit("%)."))).otherwise(".")
    entry = lambda text, tone: F.struct(text.alias("text"), tone.alias("tone"))
    revenue = entry(F.concat(render("Revenue {w} from {a} to {b}", w=word("revenue", "grew", "fell"), a=pounds(f("revenue_a")),
                                    b=pounds(f("revenue_b"))), signed_pct), word("revenue", "good", "bad"))
    margin = F.when(f("margin_available_a") & f("margin_available_b"), entry(render(
        "Margin moved {w} from {a}% to {b}% — {t}", w=word("margin", "up", "down"), a=fixed(f("margin_a"), 0), b=fixed(f("margin_b"), 0),
        t=word("margin", "healthy full-price mix.", "watch markdown depth.")), word("margin", "good", "warn")))
    health = entry(render("Business Health {w} from {a} to {b}.", w=word("health", "improved", "declined"),
                          a=f("health_a"), b=f("health_b")), word("health", "good", "bad"))
    parts = F.concat_ws(" while ", F.concat("up", F.lit(" strengthened")), F.concat("down", F.lit(" weakened")))
    mix = F.when(parts != "", entry(F.concat(parts, F.lit(" — rebalance intake toward the winning categories.")), F.lit("warn")))
    return df.select("a", "b", F.posexplode(F.array_compact(F.array(revenue, margin, health, mix))).alias("pos", "c")).select(
        "a", "b", (F.col("pos") + 1).alias("pos"), "c.text", "c.tone")
