"""The role view of a dataset: stock and plan metrics, risks, opportunities, six actions.

``heads`` condenses the stored tables to one row per dataset with conditional aggregates
(first markdown, first reorder, weakest category, ...). All texts and decisions after it
are projections of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.money import fixed, gbp_compact, grouped, pounds
from tradeloom.functions.numbers import percent_of
from tradeloom.functions.templates import render
from tradeloom.operators.alerts import top_per
from tradeloom.operators.rollup import week_order

# The sentences this module puts into results are given wording, word for word.

DS = "dataset_id"
AT_RISK = ["AT RISK", "CRITICAL"]


def at_rank(n: int, *columns: str) -> Column:
    """Struct of the row with the given rank."""
    return F.max(F.when(F.col("rank") == n, F.struct(*columns)))


def heads(kpis: DataFrame, best: DataFrame, reorder: DataFrame, markdown: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per dataset with everything the role view needs."""
    revenue = F.col("revenue").cast("decimal(18,2)")
    missing = lambda c: F.col(c).isNull() | (F.col(c) == 0)
    b = best.groupBy(DS).agg(
        at_rank(1, "sku", "revenue").alias("best1"),
        F.coalesce(F.sum("stock"), F.lit(0.0)).alias("stock_units"),
        F.count_if(missing("stock") | missing("margin_pct") | missing("sell_through")).alias("missing_data_count"),
    )
    pressing = F.col("urgency").isin("CRITICAL", "URGENT")
    ro = ["sku", "urgency", "revenue", "category"]
    r = reorder.groupBy(DS).agg(
        at_rank(1, *ro).alias("ro1"), at_rank(2, *ro).alias("ro2"),
        F.min_by("sku", F.when(F.col("urgency") == "CRITICAL", F.col("rank"))).alias("critical_sku"),
        F.count_if(pressing).alias("open_po_count"),
        F.sum(F.when(pressing, revenue)).alias("open_po_revenue"),
    )
    md = ["sku", "severity", "revenue", "sell_through", "recommended_depth"]
    m = markdown.groupBy(DS).agg(at_rank(1, *md).alias("md1"), at_rank(2, *md).alias("md2"), F.count("*").alias("markdown_rows"))
    by_revenue = F.struct((-F.col("revenue")).alias("r"), F.col("category").alias("c"))
    cat = F.struct("category", "revenue", "avg_sell_through", "health")
    weak, strong = F.col("health").isin(AT_RISK), F.col("health") == "STRONG"
    c = categories.groupBy(DS).agg(
        F.min_by(cat, by_revenue).alias("top_cat"),
        F.min_by(cat, F.when(weak, by_revenue)).alias("weak_cat"),
        F.min_by(cat, F.when(strong, by_revenue)).alias("strong_cat"),
        F.count_if(weak).alias("weak_count"),
    )
    out = kpis
    for side in (b, r, m, c):
        out = out.join(side, DS, "left")
    return out.fillna(0, ["stock_units", "missing_data_count", "open_po_count", "markdown_rows", "weak_count"])


def open_po_value() -> Column:
    return F.coalesce(F.round(F.col("open_po_revenue") * F.lit(0.15).cast("decimal(4,2)"), 2).cast("double"), F.lit(0.0))


def role_metrics(h: DataFrame) -> DataFrame:
    skus = F.col("sku_count")
    quality = F.round((skus - F.col("missing_data_count")) / F.greatest(skus, F.lit(1)) * 100, 1)
    return h.select(
        DS, F.bround("stock_units", 0).cast("bigint").alias("total_stock_units"),
        F.round(F.col("total_revenue") * 0.5 / 12, 2).alias("total_stock_value"),
        "missing_data_count", quality.alias("data_quality_pct"), "open_po_count", open_po_value().alias("open_po_value"))


def plan_vs_actual(h: DataFrame) -> DataFrame:
    rev, mg, stock = F.col("total_revenue"), F.col("avg_margin_pct"), F.bround("stock_units", 0)
    plan = h.select(DS, rev.alias("rev"), mg.alias("mg"), stock.alias("stock"),
                    F.round(rev * 1.05, 2).alias("revenue_plan"), F.round(mg * 1.08, 1).alias("margin_plan"),
                    F.bround(stock * 0.92, 0).alias("stock_plan"))
    share = lambda a, p: F.coalesce(F.round(percent_of(F.col(a), F.col(p)), 1), F.lit(0.0))
    return plan.select(
        DS, "revenue_plan", "margin_plan", "stock_plan", share("rev", "revenue_plan").alias("revenue_pct"),
        share("mg", "margin_plan").alias("margin_pct"),
        F.round(F.col("stock") / F.greatest(F.col("stock_plan"), F.lit(1.0)) * 100, 1).alias("stock_pct"))


def action(kind, sku, description, revenue, margin, confidence, priority) -> Column:
    """One action of the role view as a struct."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(kind).alias("type"), lit(sku).alias("sku"), lit(description).alias("description"),
        F.bround(lit(revenue), 0).cast("double").alias("revenue_impact"), lit(float(margin)).alias("margin_impact"),
        lit(confidence).alias("confidence"), lit(priority).alias("priority"))


# Six slots per dataset.
SLOTS = 6


def role_actions(h: DataFrame) -> DataFrame:
    """Exactly six ranked actions per dataset."""
    f = F.col
    depth = lambda s: f(f"{s}.recommended_depth")
    md1 = action("Markdown", f("md1.sku"),
                 render("Reduce price {d} to clear excess stock and free working capital", d=depth("md1")),
                 f("md1.revenue") * 0.3, -8.5, 87, F.when(f("md1.severity") == "CLEARANCE", "Critical").otherwise("Urgent"))
    ro1 = action("Reorder", f("ro1.sku"), "Replenish immediately to maintain 6-week cover and protect revenue",
                 f("ro1.revenue") * 1.2, 2.3, 92, F.when(f("ro1.urgency") == "CRITICAL", "Critical").otherwise("Urgent"))
    md2 = action("Markdown", f("md2.sku"), render("Tactical {d} price reduction to stimulate demand", d=depth("md2")),
                 f("md2.revenue") * 0.15, -4.2, 79,
                 F.when(f("md2.severity").isin("CLEARANCE", "DEEP"), "Urgent").otherwise("Recommended"))
    weak = action("Cancel PO", f("weak_cat.category"),
                  render("Review and reduce forward orders for {c} — low sell-through signals weak demand", c=f("weak_cat.category")),
                  f("weak_cat.revenue") * -0.1, 3.1, 74, "Recommended")
    ro2 = action("Reorder", f("ro2.sku"), "Secondary replenishment — prevent stockout before next delivery window",
                 f("ro2.revenue") * 0.8, 1.8, 85, "Urgent")
    strong = action("Monitor", f("strong_cat.category"),
                    render("Accelerate {c} intake — strong sell-through of {st}% signals untapped demand",
                           c=f("strong_cat.category"), st=fixed(f("strong_cat.avg_sell_through"), 0)),
                    f("strong_cat.revenue") * 0.25, 1.5, 81, "Recommended")
    sellers = action("Monitor", F.coalesce(f("best1.sku"), F.lit("Top SKU")),
                     "Monitor best sellers daily — high velocity risks stockout without adequate cover",
                     f("total_revenue") * 0.05, 0.5, 76, "Recommended")
    otb = action("Reorder", "OTB Review",
                 render("Reallocate OTB from underperforming categories to top performers — estimated {m}% margin uplift available",
                        m=fixed(f("avg_margin_pct"), 0)),
                 f("total_revenue") * 0.08, 2.0, 70, "Recommended")
    review = action("Monitor", "Range Review", "Conduct weekly range review to identify emerging trends and risks",
                    F.lit(0.0), 0.0, 65, "Recommended")
    slots = F.array(
        F.when(f("md1").isNotNull(), md1), F.when(f("ro1").isNotNull(), ro1), F.when(f("md2").isNotNull(), md2),
        F.when(f("weak_cat").isNotNull(), weak).when(f("ro2").isNotNull(), ro2),
        F.when(f("strong_cat").isNotNull(), strong).otherwise(sellers), otb)
    filled = F.slice(F.concat(F.array_compact(slots), F.array_repeat(review, SLOTS)), 1, SLOTS)
    rows = h.select(DS, F.posexplode(filled).alias("pos", "a"))
    return rows.select(DS, (F.col("pos") + 1).alias("rank"), "a.*")


def commercial_impact(actions: DataFrame, kpis: DataFrame) -> DataFrame:
    """Upside and revenue at stake over the role actions, and margin protected."""
    impact = F.col("revenue_impact")
    sums = actions.groupBy(DS).agg(F.sum(F.greatest(impact, F.lit(0.0))).alias("up"), F.sum(F.least(impact, F.lit(0.0))).alias("down"))
    return kpis.join(sums, DS).select(
        DS, F.bround(F.abs("down"), 0).cast("bigint").alias("revenue_at_stake"),
        F.bround(F.col("total_revenue") * 0.04, 0).cast("bigint").alias("margin_protect"),
        F.bround("up", 0).cast("bigint").alias("total_upside"))


def action_evidence(actions: DataFrame, markdown: DataFrame, reorder: DataFrame, categories: DataFrame,
                    best: DataFrame, kpis: DataFrame) -> DataFrame:
    """Why each role action is recommended.

    The item of an action is looked up in the markdown, reorder, category and seller
    tables; the first table that knows it decides the reasoning.
    """
    pick = lambda df, name, *cols: df.select(DS, "sku", F.struct(*cols).alias(name))
    md = pick(markdown, "md", "sell_through", "revenue", "recommended_depth", "category")
    ro = pick(reorder, "ro", "cover_weeks", "sell_through", "stock", "revenue", "urgency", "category")
    bs = pick(best, "bs", "revenue", "category")
    cat_cols = F.struct("revenue", "avg_sell_through", "health", "sku_count")
    cat = categories.select(DS, F.col("category").alias("sku"), cat_cols.alias("cat"))
    avg = categories.select(DS, F.col("category").alias("item_category"), F.col("avg_sell_through").alias("category_avg_st"))
    range_avg = kpis.select(DS, F.col("avg_sell_through").alias("avg_st"), F.col("avg_cover_weeks").alias("avg_cover"))
    joined = actions
    for side in (md, ro, cat, bs):
        joined = joined.join(side, [DS, "sku"], "left")
    joined = joined.join(range_avg, DS).withColumn(
        "item_category", F.coalesce("md.category", "ro.category", "bs.category")).join(avg, [DS, "item_category"], "left")
    f = F.col
    source = F.when(f("md").isNotNull(), "markdown").when(f("ro").isNotNull(), "reorder").when(
        f("cat").isNotNull(), "category").otherwise("generic")
    cst = f("cat.avg_sell_through")
    below = F.coalesce(cst < f("avg_st"), F.lit(False))
    why_md = F.concat(
        render("{s} is selling at just {st}% — ", s=f("sku"), st=fixed(f("md.sell_through"), 0)),
        F.when(f("category_avg_st").isNotNull(),
               render("well below the {c} category average of {a}%", c=f("item_category"), a=fixed(f("category_avg_st"), 0)))
        .otherwise(render("below the {a}% range average", a=fixed(f("avg_st"), 0))),
        render(". Acting now releases {v} of trapped stock before it ages further.", v=gbp_compact(f("md.revenue"))))
    why_ro = F.concat(
        f("sku"), F.lit(" has "),
        F.when(f("ro.cover_weeks").isNotNull(), render("only {c} weeks of cover left", c=fixed(f("ro.cover_weeks"), 1)))
        .otherwise("cover running low"),
        F.when(f("ro.sell_through").isNotNull(), render(" against {s}% sell-through", s=fixed(f("ro.sell_through"), 0))).otherwise(""),
        render(", putting {v} of demand at risk if it stocks out before the next delivery.", v=gbp_compact(f("ro.revenue"))))
    why_cat = F.when(below, render(
        "{s} is rated {h} with {c}% sell-through, below the {a}% range average — trimming forward commitment protects margin.",
        s=f("sku"), h=F.initcap(F.lower("cat.health")), c=fixed(cst, 0), a=fixed(f("avg_st"), 0))).otherwise(render(
            "{s} is your strongest category at {v} revenue and {c}% sell-through — leaning in captures demand outpacing supply.",
            s=f("sku"), v=gbp_compact(f("cat.revenue")), c=fixed(F.coalesce(cst, F.lit(0.0)), 0)))
    pct = lambda c: F.concat(fixed(c, 0), F.lit("%"))
    weeks = lambda c: F.concat(fixed(c, 1), F.lit(" wks"))
    point = lambda label, value: F.when(value.isNotNull(), F.concat(label if isinstance(label, Column) else F.lit(label), F.lit("="), value))
    points = (
        F.when(source == "markdown", F.array(
            point("Sell-through", pct(f("md.sell_through"))),
            F.coalesce(point(F.concat("item_category", F.lit(" avg ST")), pct(f("category_avg_st"))), point("Range avg ST", pct(f("avg_st")))),
            point("Stock value tied up", gbp_compact(f("md.revenue"))), point("Recommended depth", f("md.recommended_depth"))))
        .when(source == "reorder", F.array(
            point("Weeks of cover", weeks(f("ro.cover_weeks"))), point("Sell-through", pct(f("ro.sell_through"))),
            point("Stock on hand", F.concat(grouped(f("ro.stock")), F.lit(" units"))),
            point("Revenue at risk", gbp_compact(f("ro.revenue"))), point("Urgency", F.initcap(F.lower("ro.urgency")))))
        .when(source == "category", F.array(
            point("Category revenue", gbp_compact(f("cat.revenue"))), point("Avg sell-through", pct(cst)),
            point("Health", F.initcap(F.lower("cat.health"))), point("SKUs in range", f("cat.sku_count").cast("string"))))
        .otherwise(F.array(
            point("Range avg ST", pct(f("avg_st"))), point("Range avg cover", weeks(f("avg_cover"))),
            F.when(f("bs").isNotNull(), point(F.concat("sku", F.lit(" revenue")), gbp_compact(f("bs.revenue"))))))
    )
    return joined.select(
        DS, "rank", "type", "sku", source.alias("source"), "item_category", "category_avg_st", "confidence",
        "revenue_impact", F.when(f("revenue_impact") >= 0, "Revenue recovered").otherwise("Revenue traded").alias("revenue_label"),
        "margin_impact",
        F.when(source == "markdown", why_md).when(source == "reorder", why_ro).when(source == "category", why_cat)
        .otherwise(f("description")).alias("why"),
        F.array_join(F.array_compact(points), "; ").alias("data_points"))


def risk_texts() -> Column:
    """Three risk sentences of a dataset."""
    f = F.col
    first = F.when(f("md1").isNotNull(), render(
        "{n} SKUs at markdown risk — {sku} has only {st}% sell-through, risking {rev} revenue", n=f("markdown_rows"),
        sku=f("md1.sku"), st=fixed(f("md1.sell_through"), 0), rev=pounds(f("md1.revenue")))).otherwise(
            "Monitor sell-through weekly — low ST can quickly escalate to markdown territory")
    cover = fixed(f("avg_cover_weeks"), 1)
    second = (
        F.when(f("avg_cover_weeks") > 12, render(
            "Average stock cover of {c} weeks is above target — overstocked range risks cash and margin", c=cover))
        .when(f("avg_cover_weeks") < 3, render(
            "Average stock cover of {c} weeks is critically low — risk of lost sales across the range", c=cover))
        .when(f("reorder_count") > 5, render(
            "{n} SKUs need urgent reordering — risk of stockouts impacting revenue momentum", n=f("reorder_count")))
        .otherwise("Margin erosion risk if markdown depth increases — review pricing strategy"))
    third = F.when(f("weak_cat").isNotNull(), render(
        "{n} categories rated AT RISK or CRITICAL — {c} needs immediate attention with {rev} revenue exposed",
        n=f("weak_count"), c=f("weak_cat.category"), rev=pounds(f("weak_cat.revenue")))).otherwise(render(
            "Gross margin at {m}% — if this falls below 40% it will impact profitability targets", m=fixed(f("avg_margin_pct"), 1)))
    return F.array(first, second, third)


def opportunity_texts() -> Column:
    """Three opportunity sentences of a dataset."""
    f = F.col
    first = (
        F.when(f("strong_cat").isNotNull(), render(
            "Accelerate intake in {c} — strong sell-through of {st}% signals demand outpacing supply",
            c=f("strong_cat.category"), st=fixed(f("strong_cat.avg_sell_through"), 0)))
        .when(f("best1").isNotNull(), render(
            "Focus buying power on top performers — best sellers driving {rev} each", rev=pounds(f("best1.revenue"))))
        .otherwise("Identify hero SKUs and concentrate OTB to drive sell-through"))
    second = F.when(f("reorder_count") > 0, render(
        "Rapid replenishment of {n} critical/urgent SKUs could unlock {v} in additional revenue over 6 weeks",
        n=f("open_po_count"), v=pounds(open_po_value() * 6))).otherwise(
            "Strong stock position — opportunity to negotiate better terms with suppliers given healthy cover")
    third = F.when(f("avg_margin_pct") > 45, render(
        "Gross margin at {m}% is above benchmark — explore premium pricing on hero SKUs to further improve profitability",
        m=fixed(f("avg_margin_pct"), 1))).otherwise(
            "Markdown execution on slow movers will release working capital and improve overall range margin")
    return F.array(first, second, third)


def exploded(h: DataFrame, texts: Column, name: str) -> DataFrame:
    return h.select(DS, F.posexplode(texts).alias("pos", name)).withColumn("pos", F.col("pos") + 1)


def top_risks(h: DataFrame) -> DataFrame:
    return exploded(h, risk_texts(), "risk")


def top_opportunities(h: DataFrame) -> DataFrame:
    return exploded(h, opportunity_texts(), "opportunity")


def executive_summary_text() -> Column:
    f = F.col
    plan = F.round(f("total_revenue") * 1.05, 2)
    pct = F.coalesce(F.round(percent_of(f("total_revenue"), plan), 1), F.lit(0.0))
    st = f("top_cat.avg_sell_through")
    lead = F.when(f("top_cat").isNotNull(), F.concat(
        render("{c} is the top performing category at {rev} revenue", c=f("top_cat.category"), rev=pounds(f("top_cat.revenue"))),
        F.when(F.coalesce(st, F.lit(0.0)) != 0, render(" and {st}% sell-through.", st=fixed(st, 0))).otherwise(".")))
    weak = F.when(f("weak_cat").isNotNull(), render(
        "{c} is flagged as {h} with only {st}% sell-through — immediate action required.", c=f("weak_cat.category"),
        h=f("weak_cat.health"), st=fixed(f("weak_cat.avg_sell_through"), 0)))
    stock = F.when(f("critical_oos_count") > 0, render(
        "{n} SKUs are critically out-of-stock — emergency reorder recommended to prevent further revenue loss.",
        n=f("critical_oos_count"))).when(f("reorder_count") > 0, render(
            "{n} SKUs require reorder action to maintain adequate cover across the range.", n=f("reorder_count")))
    mg = f("avg_margin_pct")
    verb = F.when(f("markdown_rows") > 3, "Prioritise markdown execution").otherwise("Maintain pricing discipline")
    uplift = F.round(F.try_divide(mg * 1.05 - mg, mg) * 100, 1)
    margin = F.when(mg > 0, render("{v} to optimise margin by approximately {u}% over the next 4 weeks.", v=verb, u=fixed(uplift, 1)))
    return F.concat_ws(" ", render("Trading is performing {w} plan at {p}% of revenue target.",
                                   w=F.when(pct >= 100, "above").otherwise("below"), p=fixed(pct, 0)), lead, weak, stock, margin)


def executive_summary(h: DataFrame) -> DataFrame:
    return h.select(DS, executive_summary_text().alias("executive_summary"))


def extremes(h: DataFrame) -> DataFrame:
    """First items of each list."""
    return h.select(DS, F.col("top_cat.category").alias("top_category"), F.col("weak_cat.category").alias("risk_category"),
                    F.col("best1.sku").alias("top_sku"), F.col("critical_sku"), F.col("md1.sku").alias("top_markdown_sku"))


def quick_insights(kpis: DataFrame) -> DataFrame:
    texts = F.array(
        render("Raise POs immediately for {n} out-of-stock SKUs before revenue is lost.", n=F.col("critical_oos_count")),
        render("Review {n} slow-selling SKUs for tactical markdowns to protect margin.", n=F.col("markdown_risk_count")),
        render("Overall sell-through of {st}% indicates overbought range — tighten next season's OTB.", st=fixed(F.col("avg_sell_through"), 1)))
    return exploded(kpis, texts, "insight")


# Points of the sparkline and the factor of each point put in front.
SPARK_POINTS, SPARK_FADE = 8, 0.95


def sparkline(kpis: DataFrame, weekly: DataFrame) -> DataFrame:
    """Last 8 weekly revenues, padded in front; a synthetic ramp when there are no weeks."""
    last = top_per(weekly.withColumn("at", week_order()), [DS], [F.desc("at")], SPARK_POINTS)
    got = last.groupBy(DS).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "revenue"))), lambda s: s["revenue"]).alias("got"))
    missing = F.lit(SPARK_POINTS) - F.size("got")
    faded = F.transform(F.sequence(F.lit(SPARK_POINTS), F.lit(1), F.lit(-1)), lambda i: F.element_at("got", 1) * F.pow(F.lit(SPARK_FADE), i))
    padded = F.concat(F.slice(faded, F.lit(SPARK_POINTS + 1) - missing, missing), F.col("got"))
    base = F.col("total_revenue") / 52
    ramp = F.transform(F.sequence(F.lit(0), F.lit(SPARK_POINTS - 1)), lambda i: F.round(
        base * (F.lit(0.85) + F.lit(0.03) * i + F.when(i % 3 == 0, F.lit(0.05)).otherwise(F.lit(0.0))), 2))
    joined = kpis.select(DS, "total_revenue").join(got, DS, "left")
    points = F.when(F.col("got").isNull(), ramp).otherwise(padded)
    return joined.select(DS, F.posexplode(points).alias("pos", "value")).select(
        DS, (F.col("pos") + 1).alias("point"), F.round("value", 2).alias("value"))


def trend_direction(weekly: DataFrame) -> DataFrame:
    """Direction over the last six weeks."""
    last = top_per(weekly.withColumn("at", week_order()), [DS], [F.desc("at")], 6).groupBy(DS).agg(
        F.count("*").alias("n"), F.min_by("revenue", "at").alias("first"), F.max_by("revenue", "at").alias("last"))
    rule = F.when((F.col("n") >= 2) & (F.col("last") > F.col("first")), "improving").when(
        (F.col("n") >= 2) & (F.col("last") < F.col("first")), "declining").otherwise("stable")
    return last.select(DS, rule.alias("trend"))
