"""Development of a user's datasets over time.

Datasets of a user are numbered in slices, and each is joined with the one before by its
number: no step needs all datasets of a user in one task, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.money import fixed, gbp_compact, pounds, signed
from tradeloom.functions.numbers import percent_of
from tradeloom.functions.templates import render
from tradeloom.operators.health import health_label, key_recommendation
from tradeloom.operators.ordering import numbered
from tradeloom.operators.rollup import week_order
from tradeloom.operators.workspace import DS, catalogue, dataset_cards

# The sentences this module puts into results are given wording, word for word.

METRICS = {"Revenue": ("revenue", "£"), "Margin": ("margin", "%"), "Sell-Through": ("sell_through", "%"), "Health Score": ("health", "")}


def timeline(datasets: DataFrame, kpis: DataFrame) -> DataFrame:
    """Non-trashed datasets per user, oldest first."""
    cards = dataset_cards(catalogue(datasets), kpis).where(~F.col("trashed"))
    points = cards.select(
        "user_id", DS, F.col("display_name").alias("label"), F.col("upload_date").alias("date"), "revenue", "margin",
        "sell_through", F.col("health_score").alias("health"), F.col("record_count").alias("records"),
        key_recommendation(F.col("sell_through"), F.col("margin")).alias("key_rec"))
    return numbered(points, ["user_id"], [F.col("date"), F.col(DS)], "seq")


def with_previous(points: DataFrame, columns: list[str]) -> DataFrame:
    """Points with figures of the dataset before as ``prev_``; only those figures are moved."""
    before = points.select("user_id", (F.col("seq") + 1).alias("seq"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return points.join(before, ["user_id", "seq"], "left")


MOVING = [c for c, _ in METRICS.values()]


def timeline_delta(points: DataFrame) -> DataFrame:
    """Moves of each dataset against the one before; ``is_latest`` marks the newest step."""
    newest = points.groupBy("user_id").agg(F.max("seq").alias("newest"))
    df = with_previous(points, MOVING).join(newest, "user_id").withColumn("is_latest", F.col("seq") == F.col("newest"))
    rows = []
    for name, (c, unit) in METRICS.items():
        cur, prev = F.col(c).cast("double"), F.col(f"prev_{c}").cast("double")
        d = cur - prev
        rows.append(F.when(F.coalesce(prev, F.lit(0.0)) != 0, F.struct(
            F.lit(name).alias("metric"), F.when(d > 0, "up").when(d < 0, "down").otherwise("flat").alias("direction"),
            F.round(d, 1).alias("change"), F.round(percent_of(d, prev), 1).alias("pct"), F.lit(unit).alias("unit"))))
    return df.select("user_id", DS, "seq", "is_latest", F.inline(F.array_compact(F.array(*rows))))


def business_memory(points: DataFrame) -> DataFrame:
    """KPI moves of at least half a unit against the dataset before."""
    df = with_previous(points, MOVING).where(F.col("prev_revenue").isNotNull())
    labels = {"revenue": "Revenue", "margin": "Margin", "sell_through": "Sell-through", "health": "Business Health"}
    rows = []
    for c, label in labels.items():
        d = F.col(c).cast("double") - F.col(f"prev_{c}").cast("double")
        plus = F.when(d >= 0, "+").otherwise("")
        text = (F.concat(F.lit(f"{label} "), plus, pounds(d)) if c == "revenue" else
                F.concat(F.lit(f"{label} "), plus, fixed(d, 1), F.lit("%" if c != "health" else " pts")))
        rows.append(F.when(F.abs(d) >= 0.5, F.struct(
            F.lit(c).alias("metric"), F.when(d >= 0, "improved").otherwise("declined").alias("outcome"),
            F.round(d, 2).alias("diff"), text.alias("text"))))
    return df.select("user_id", DS, "seq", F.inline(F.array_compact(F.array(*rows))))


# Risks listed per kind.
RISKS_KEPT = {"new": 3, "resolved": 3, "recurring": 2}


def risk_diff(points: DataFrame, risks: DataFrame) -> DataFrame:
    """New, resolved and recurring risk sentences against the dataset before.

    ``risks``: dataset_id and an array of three sentences.
    """
    df = with_previous(points.select("user_id", DS, "seq").join(risks, DS), ["risks"]).withColumnRenamed("prev_risks", "prev")
    kinds = {"new": F.array_except("risks", "prev"), "resolved": F.array_except("prev", "risks"),
             "recurring": F.array_intersect("risks", "prev")}

    def entries_of(kind: str, risks: Column) -> Column:
        kept = F.slice(F.array_sort(risks), 1, RISKS_KEPT[kind])
        return F.transform(kept, lambda r, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("pos"), r.alias("risk")))

    entries = [entries_of(k, a) for k, a in kinds.items()]
    return df.where(F.col("prev").isNotNull()).select("user_id", DS, F.inline(F.flatten(F.array(*entries))))


def periods(weekly: DataFrame) -> DataFrame:
    ends = weekly.groupBy(DS).agg(F.min_by("week", week_order()).alias("first"), F.max_by("week", week_order()).alias("last"))
    text = F.when(F.col("first") != F.col("last"), F.concat_ws(" – ", "first", "last")).otherwise(F.col("first"))
    return ends.select(DS, text.alias("period"))


def up_down(delta: Column) -> Column:
    return F.when(delta.isNull(), "flat").when(delta >= 0, "up").otherwise("down")


def review_moves(points: DataFrame) -> DataFrame:
    """Points with their moves: revenue in %, margin and sell-through only over a real base."""
    df = with_previous(points, MOVING)
    nonzero = lambda c: F.nullif(F.col(f"prev_{c}").cast("double"), F.lit(0.0))
    return df.select(
        *points.columns, percent_of(F.col("revenue") - F.col("prev_revenue"), F.col("prev_revenue")).alias("rev_delta"),
        (F.col("margin") - nonzero("margin")).alias("mg_delta"), (F.col("sell_through") - nonzero("sell_through")).alias("st_delta"),
        (F.col("health") - F.col("prev_health")).alias("health_delta"))


def trading_review(points: DataFrame, kpis: DataFrame, categories: DataFrame, weekly: DataFrame) -> DataFrame:
    """Overview and "what changed" rows of the weekly trading review."""
    by_revenue = F.struct((-F.col("revenue")).alias("r"), F.col("category").alias("c"))
    lead = categories.groupBy(DS).agg(F.min_by(F.struct("category", "revenue"), by_revenue).alias("top"))
    extra = kpis.select(DS, "margin_available", "markdown_risk_count", "avg_cover_weeks")
    df = review_moves(points).join(extra, DS).join(lead, DS, "left").join(periods(weekly), DS, "left").withColumn(
        "period", F.coalesce("period", F.lit("Latest trading period")))
    f = F.col
    ok, md = f("margin_available"), f("markdown_risk_count")
    none = F.lit(None).cast("string")
    pct = lambda c: F.when(c.isNotNull(), F.concat(signed(c, 1), F.lit("%")))
    row = lambda section, title, value, delta, trend, note: F.struct(
        F.lit(section).alias("section"), F.lit(title).alias("title"), value.alias("value"), delta.alias("delta"),
        trend.alias("trend"), note.alias("note"))
    rd, mgd, sd, hd = f("rev_delta"), F.when(ok, f("mg_delta")), f("st_delta"), f("health_delta")
    insufficient = F.lit("Insufficient data")
    margin_value = F.when(ok, F.concat(fixed(f("margin"), 1), F.lit("%"))).otherwise(insufficient)
    cover = fixed(f("avg_cover_weeks"), 0)
    rows = F.array(
        row("overview", "Revenue", gbp_compact(f("revenue")), pct(rd), up_down(rd),
            F.when(rd.isNotNull(), "vs last week").otherwise("this period")),
        row("overview", "Margin", margin_value, pct(mgd), up_down(mgd), F.lit("blended margin")),
        row("overview", "Sell-Through", F.concat(fixed(f("sell_through"), 0), F.lit("%")), pct(sd), up_down(sd),
            F.when(sd.isNotNull(), "WoW").otherwise("range average")),
        row("overview", "Health Score", F.concat(f("health").cast("string"), F.lit("/100")),
            F.when(hd.isNotNull(), F.concat(F.when(hd >= 0, "+").otherwise(""), hd.cast("string"), F.lit(" pts"))),
            up_down(hd), health_label(f("health"))),
        row("change", "Revenue Movement", F.coalesce(pct(rd), gbp_compact(f("revenue"))), none, up_down(rd),
            F.coalesce(render("Driven by {c} ({v})", c=f("top.category"), v=pounds(f("top.revenue"))), F.lit("Across the range"))),
        row("change", "Margin Movement", F.when(ok, F.coalesce(pct(mgd), margin_value)).otherwise(insufficient), none, up_down(mgd),
            F.when(~ok, "This dataset has no margin column — add one to track margin movement.")
            .when(md > 3, "Markdown dependency on slow movers").otherwise("Stable pricing across the range")),
        row("change", "Stock Position", F.when(md != 0, render("{n} SKUs flagged", n=md)).otherwise("Clean"), none,
            F.when(md > 5, "down").otherwise("flat"),
            F.when(md != 0, render("Slow/overstocked lines at ~{c} wks average cover", c=cover))
            .otherwise(render("Healthy cover at ~{c} wks across the range", c=cover))))
    return df.select("user_id", DS, "period", F.posexplode(rows).alias("pos", "r")).select(
        "user_id", DS, "period", (F.col("pos") + 1).alias("pos"), "r.*")
