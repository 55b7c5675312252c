"""Health scores, verdicts and recommendations as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.money import fixed
from tradeloom.functions.numbers import clamp, or_default

# The sentences this module puts into results are given wording, word for word.

DS = "dataset_id"


def steps(value: Column, bounds: list[tuple[float, int]], last: int) -> Column:
    """Points of the first bound the value reaches."""
    rule = None
    for bound, points in bounds:
        hit = value >= bound
        rule = F.when(hit, points) if rule is None else rule.when(hit, points)
    return rule.otherwise(last)


def category_health(st: Column) -> Column:
    """Health word of a category. A missing or zero sell-through says nothing."""
    known = F.when(st.isNotNull() & (st != 0), st)
    return F.when(known.isNull(), "UNKNOWN").when(known >= 40, "STRONG").when(known >= 25, "HEALTHY").when(
        known >= 15, "AT RISK").otherwise("CRITICAL")


def category_health_score(st: Column, margin: Column) -> Column:
    """0-100 from sell-through (55 points) and margin (45 points)."""
    s, m = F.coalesce(st, F.lit(0.0)), F.coalesce(margin, F.lit(0.0))
    score = F.least(s, F.lit(100.0)) / 100 * 55 + F.least(m, F.lit(60.0)) / 60 * 45
    return F.when((s == 0) & (m == 0), F.lit(0)).otherwise(F.bround(clamp(score, 0.0, 100.0), 0).cast("int"))


def key_recommendation(st: Column, margin: Column) -> Column:
    return (
        F.when(st >= 70, "Reorder best-sellers — strong sell-through, protect availability")
        .when(st < 45, "Trigger early markdown on slow stock to release cash")
        .when(margin < 40, "Review pricing & markdown depth to protect margin")
        .otherwise("Hold and monitor — trading in line with plan")
    )


def trading_verdict(st: Column, margin: Column) -> Column:
    return F.when((st >= 45) & (margin >= 45), "positive").when(st < 25, "under pressure").otherwise("mixed")


def legacy_health_score(st: Column, margin: Column, cover: Column, reorders: Column) -> Column:
    """Older score of four components worth 25 points each."""
    cover_points = (
        F.when(cover.between(4, 8), 25)
        .when(((cover >= 2) & (cover < 4)) | ((cover > 8) & (cover <= 12)), 18)
        .when((cover >= 1) & (cover < 2), 10).otherwise(3)
    )
    reorder_points = F.when(reorders == 0, 25).when(reorders <= 3, 20).when(reorders <= 10, 12).otherwise(5)
    return steps(st, [(50, 25), (35, 20), (20, 12)], 5) + steps(margin, [(55, 25), (40, 20), (25, 12)], 5) + cover_points + reorder_points


# Key, title and maximum of each component of the health score.
COMPONENTS = [
    ("revenue", "Revenue Performance", 30), ("sell_through", "Sell-Through", 20),
    ("margin", "Margin Protection", 20), ("stock", "Stock Efficiency", 20), ("risk", "Risk Exposure", 10),
]


def status(score: Column, top: int) -> Column:
    return F.when(score / top >= 0.75, "strong").when(score / top >= 0.45, "watch").otherwise("weak")


def health_points() -> dict[str, Column]:
    """Points per component as expressions over a KPI row."""
    st = F.coalesce("avg_sell_through", F.lit(0.0))
    mg = or_default(F.col("gross_margin_pct"), F.coalesce("avg_margin_pct", F.lit(0.0)))
    cover = F.coalesce("avg_cover_weeks", F.lit(0.0))
    revenue = F.bround(F.least(F.lit(1.0), st / 85.0) * 18 + F.least(F.lit(1.0), mg / 60.0) * 12, 0).cast("int")
    margin = F.when(~F.col("margin_available"), 10).otherwise(steps(mg, [(60, 20), (50, 16), (40, 12), (30, 7)], 3))
    stock = (
        F.when(cover.between(4, 8), 18)
        .when(((cover >= 2) & (cover < 4)) | ((cover > 8) & (cover <= 12)), 13)
        .when(((cover >= 1) & (cover < 2)) | ((cover > 12) & (cover <= 16)), 7).otherwise(3)
    )
    by5 = lambda c: F.floor(F.col(c) / 5)
    risk = (F.lit(10) - F.least(F.lit(5), F.col("critical_oos_count") * 2)
            - F.least(F.lit(3), by5("reorder_count")) - F.least(F.lit(2), by5("markdown_risk_count")))
    return {
        "revenue": clamp(revenue, 0, 30),
        "sell_through": steps(st, [(70, 20), (55, 16), (40, 12), (25, 7)], 3),
        "margin": margin, "stock": stock, "risk": F.greatest(F.lit(0), risk).cast("int"),
    }


def health_total() -> Column:
    points = health_points()
    return clamp(sum(points.values(), F.lit(0)), 0, 100).cast("int")


def health_label(total: Column) -> Column:
    return F.when(total >= 80, "Healthy").when(total >= 60, "Watch").otherwise("At Risk")


def health_details() -> dict[str, Column]:
    """One sentence per component."""
    st = F.coalesce("avg_sell_through", F.lit(0.0))
    mg = or_default(F.col("gross_margin_pct"), F.coalesce("avg_margin_pct", F.lit(0.0)))
    cover = F.coalesce("avg_cover_weeks", F.lit(0.0))
    weeks = F.concat(fixed(cover, 1), F.lit(" wks cover — "))
    count = lambda c, words: F.when(F.col(c) != 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    bits = F.concat_ws(", ", count("critical_oos_count", " critical OOS"), count("reorder_count", " reorder alerts"),
                       count("markdown_risk_count", " markdown risks"))
    return {
        "revenue": F.concat(F.lit("Revenue quality from "), fixed(st, 0), F.lit("% sell-through and "), fixed(mg, 0), F.lit("% margin.")),
        "sell_through": F.concat(F.lit("Range sell-through of "), fixed(st, 1), F.lit("% — how fast stock is converting.")),
        "margin": F.when(~F.col("margin_available"), "Insufficient margin data in this dataset — scored neutrally.")
        .otherwise(F.concat(F.lit("Blended margin of "), fixed(mg, 1), F.lit("% vs a 55% healthy benchmark."))),
        "stock": F.when(cover <= 0, "No stock-cover signal in this dataset.")
        .when(cover < 4, F.concat(weeks, F.lit("running lean, stockout risk on top sellers.")))
        .when(cover <= 8, F.concat(weeks, F.lit("healthy, within the ideal 4-8 wk band.")))
        .otherwise(F.concat(weeks, F.lit("overstocked, cash tied up in slow stock."))),
        "risk": F.when(bits == "", "No critical stock or margin risks detected.")
        .otherwise(F.concat(F.lit("Live risks: "), bits, F.lit("."))),
    }


def with_health(kpis: DataFrame) -> DataFrame:
    """KPIs with the canonical score and its label."""
    scored = kpis.withColumn("health", health_total())
    return scored.withColumn("health_label", health_label(F.col("health")))


def health_breakdown(kpis: DataFrame) -> DataFrame:
    """One row per dataset and component."""
    points, details = health_points(), health_details()
    rows = []
    for key, title, top in COMPONENTS:
        state = status(points[key], top)
        if key == "margin":
            state = F.when(~F.col("margin_available"), "watch").otherwise(state)
        rows.append(F.struct(F.lit(key).alias("component"), F.lit(title).alias("name"),
                             points[key].cast("int").alias("score"), F.lit(top).alias("max_score"),
                             state.alias("status"), details[key].alias("detail")))
    total = health_total()
    return kpis.select(DS, total.alias("total"), health_label(total).alias("label"),
                       F.inline(F.array(*rows)))
