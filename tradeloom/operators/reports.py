"""Report texts, the data block for an assistant and the command centre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.money import fixed, grouped, pounds
from tradeloom.functions.templates import render
from tradeloom.operators.alerts import top_per
from tradeloom.operators.governance import outgoing_items
from tradeloom.operators.health import health_label, health_total, trading_verdict
from tradeloom.operators.role_view import commercial_impact, executive_summary_text, opportunity_texts, risk_texts

DS = "dataset_id"

# Wording of the rule-based trade report, one text per section.
REPORT = {
    "executive_summary": "Overall trading is {verdict} with {rev} in revenue and {st}% sell-through recorded across {skus} active SKUs. "
                         "{top} is the primary revenue driver, whilst {risk_stock} Recommended actions focus on {focus}.",
    "business_overview": "The business is generating {rev} in revenue from {units} units across {skus} SKUs, delivering {mg}% gross margin. "
                         "Sell-through at {st}% is {expectation}, with an average of {cover} weeks cover remaining across the estate. "
                         "There are {reorders} SKUs requiring replenishment action and {markdowns} at risk of requiring markdown support.",
    "revenue_performance": "Revenue of {rev} is being driven by {units} units at an average selling price of £{asp}. "
                           "{performer}Revenue quality {quality}.",
    "margin_performance": "Gross margin is running at {mg}%, delivering {profit} gross profit. {margin_note} "
                          "With {markdowns} SKUs carrying markdown risk, margin protection requires active management.",
    "stock_performance": "Stock cover averaging {cover} weeks {cover_note} There are {reorders} SKUs with critically low cover at risk of stockout. "
                         "{markdown_note}",
    "category_winners": "{top} is the standout category, delivering the strongest revenue contribution to the overall business. "
                        "Categories with {signals} should be prioritised for replenishment to sustain momentum.",
    "category_risks": "{concern}, with elevated stock cover and below-target sell-through. If left unmanaged, this stock position will "
                      "require deeper markdown to clear, further compressing margin and tying up working capital.",
    "markdown_risks": "There are {markdowns} SKUs carrying markdown risk across the range. {candidate} "
                      "A phased markdown strategy is recommended to maximise recovery whilst protecting margin.",
    "replenishment_opportunities": "With {reorders} SKUs at or approaching stockout, replenishment is an immediate priority. {critical} "
                                   "Failure to replenish will result in lost revenue and weakened category performance.",
    "action_1": "1. Place emergency replenishment orders on {reorders} SKUs showing critical/urgent stockout risk to prevent lost revenue.",
    "action_2": "2. Implement a phased markdown strategy on the {markdowns} highest-risk SKUs, starting at 20% to test rate-of-sale response.",
    "action_3": "3. Review forward intake commitments for {risk_or_some} and cancel or defer non-critical orders.",
    "action_4": "4. Reforecast revenue and margin for the remainder of the season based on current sell-through trajectory.",
    "action_5": "5. Prioritise full-price promotional support for strong-performing categories to sustain momentum.",
    "action_6": "6. Conduct a supplier review for categories delivering below 40% margin to identify cost-price renegotiation opportunities.",
    "weekly_trade_narrative": "This week's trading performance reflects a {verdict} business position with sell-through at {st}% and revenue of {rev}. "
                              "The immediate priority for the trading team is to address {reorders} stockout risks and initiate markdown action "
                              "on slow-moving lines. Category mix is {mix}. The key trading call this week is to protect margin on full-price "
                              "lines whilst accelerating clearance on aged stock.",
    "risk_register_summary": "The primary trading risk is concentrated in {concentration}, where elevated cover and declining sell-through create "
                             "markdown exposure. Stockout risk on {reorders} SKUs presents a secondary revenue risk if replenishment is not actioned "
                             "immediately. Margin compression from markdown dependency on {markdowns} SKUs could impact gross profit delivery for the "
                             "period. Mitigation requires immediate action on both replenishment and clearance markdown.",
    "category_summary": "The category portfolio is showing mixed performance with {top} leading and {risk_or_several} under pressure.",
    "winners_detail": "{top} and strong-performing categories are delivering above-target sell-through and supporting overall revenue delivery.",
    "risks_detail": "{risk_or_under} require urgent commercial intervention to prevent margin erosion and excess stock accumulation.",
}


def report_fields() -> dict[str, Column]:
    f = F.col
    st, mg, cover = f("avg_sell_through"), f("avg_margin_pct"), f("avg_cover_weeks")
    risk, md = f("weak_cat.category"), f("markdown_risk_count")
    choose = lambda condition, yes, no: F.when(condition, yes).otherwise(no)
    given = lambda c, template, other: F.when(c.isNotNull(), render(template, x=c)).otherwise(other)
    return {
        "verdict": trading_verdict(st, mg), "rev": pounds(f("total_revenue")), "st": fixed(st, 0), "skus": f("sku_count"),
        "units": grouped(f("total_units")), "mg": fixed(mg, 1), "cover": fixed(cover, 1), "reorders": f("reorder_count"), "markdowns": md,
        "profit": pounds(f("gross_profit")), "asp": fixed(f("total_revenue") / F.greatest(f("total_units"), F.lit(1)), 2),
        "top": F.coalesce(f("top_cat.category"), F.lit("the top category")),
        "risk_stock": given(risk, "{x} presents the most significant stock risk.", "stock cover requires monitoring."),
        "focus": choose(st >= 40, "protecting full-price sell-through", "accelerating clearance and improving rate of sale"),
        "expectation": choose(st >= 45, "ahead of expectations", "below target"),
        "performer": given(f("best1.sku"), "Top performer {x} is contributing significantly to overall revenue delivery. ", ""),
        "quality": choose(st >= 45, "appears healthy with strong full-price activity", "is under pressure with elevated markdown dependency"),
        "margin_note": choose(mg >= 45, "Margin is above the 45% threshold, indicating disciplined full-price selling.",
                              "Margin is below the 45% target — intake pricing or markdown activity is compressing returns."),
        "cover_note": choose(cover.between(4, 8), "is within the target 4–8 week range.", "is outside target, requiring rebalancing action."),
        "markdown_note": F.when(md > 0, render("Markdown risk across {n} SKUs represents potential working capital trapped in slow-moving lines.", n=md))
        .otherwise("Markdown exposure is currently minimal."),
        "signals": choose(f("strong_cat").isNotNull(), "strong health signals", "healthy sell-through"),
        "concern": given(risk, "{x} is the primary area of concern", "At-risk categories require immediate attention"),
        "candidate": given(f("md1.sku"), "{x} is the highest-priority markdown candidate.", "Markdown candidates span multiple categories."),
        "critical": given(f("critical_sku"), "{x} is the most critical.", "Critical SKUs should be fast-tracked for reorder."),
        "risk_or_some": F.coalesce(risk, F.lit("at-risk categories")), "risk_or_several": F.coalesce(risk, F.lit("several categories")),
        "risk_or_under": F.coalesce(risk, F.lit("Underperforming categories")),
        "mix": choose(st >= 40, "favouring stronger performers", "showing signs of strain across multiple departments"),
        "concentration": given(risk, "the {x} category", "slow-moving categories"),
    }


def trade_report(h: DataFrame) -> DataFrame:
    """One row per dataset and report section."""
    fields = report_fields()
    rows = [F.struct(F.lit(k).alias("section"), render(t, **fields).alias("text")) for k, t in REPORT.items()]
    return h.select(DS, F.inline(F.array(*rows)))


# Rows of each table in the data blocks.
BLOCK_ROWS, REPORT_ROWS, REPORT_CATEGORIES = 8, 5, 8


def context_lines(kpis: DataFrame, best: DataFrame, reorder: DataFrame, markdown: DataFrame, categories: DataFrame,
                  private: DataFrame, alerts: int = BLOCK_ROWS) -> DataFrame:
    """Data block for an assistant as ordered JSON lines per dataset. Of the datasets in
    ``private`` only figures leave: no items, and categories without their names.

    One row per line, not one text per dataset, so a dataset with very many categories
    never becomes one oversized value.
    """
    best, reorder, markdown = (outgoing_items(x, private) for x in (best, reorder, markdown))
    hidden = categories.join(private.withColumn("_private", F.lit(True)), DS, "left")
    categories = hidden.withColumn("category", F.when(F.col("_private").isNull(), F.col("category"))).drop("_private")
    line = lambda df, section, order: df.select(
        DS, F.lit(section).alias("section"), order.cast("double").alias("seq"),
        F.to_json(F.struct(*[c for c in df.columns if c not in (DS, "rank", "role_mask")])).alias("line"))
    first = lambda df: df.where(F.col("rank") <= alerts)
    return reduce(DataFrame.unionByName, [
        line(kpis, "kpis", F.lit(1)), line(first(reorder), "top_reorders", F.col("rank")),
        line(first(markdown), "top_markdown_risk", F.col("rank")), line(first(best), "best_sellers", F.col("rank")),
        line(categories, "categories", -F.col("revenue")),
    ])


# Lines of the report's data block.
REPORT_LINES = [
    "Revenue: {rev}", "Units Sold: {units}", "Gross Profit: {profit}", "Gross Margin %: {mg}%", "Sell-Through: {st}%", "Avg Stock Cover: {cover} weeks",
    "SKU Count: {skus}", "Revenue Trend (recent): {trend}", "Reorder Alerts: {reorders} total ({critical} critical)", "Markdown Risk SKUs: {markdowns}",
]
CATEGORY_LINE = "{category}: {rev} rev, {st}% ST, {mg}% margin, Health: {health}"
REORDER_LINE = "{sku} ({category}) [{urgency}]: {cover} wks cover, {st}% ST"
MARKDOWN_LINE = "{sku} ({category}): {st}% ST, {severity}"
SELLER_LINE = "{sku}: {rev}, {st}% ST"


def report_context(kpis: DataFrame, best: DataFrame, reorder: DataFrame, markdown: DataFrame, categories: DataFrame, trend: DataFrame, private: DataFrame) -> DataFrame:
    """Data block of the trade report as text lines per dataset and section; of the datasets in
    ``private`` the summary alone."""
    f = F.col
    best, reorder, markdown = (outgoing_items(x, private) for x in (best, reorder, markdown))
    categories = categories.join(private, DS, "left_anti")
    known = lambda c, other: F.coalesce(f(c).cast("string"), F.lit(other))
    fields = {
        "rev": pounds(f("total_revenue")), "units": grouped(f("total_units")), "profit": pounds(f("gross_profit")), "mg": fixed(f("avg_margin_pct"), 1),
        "st": fixed(f("avg_sell_through"), 1), "cover": fixed(f("avg_cover_weeks"), 1), "skus": f("sku_count"), "trend": F.coalesce("trend", F.lit("stable")),
        "reorders": f("reorder_count"), "critical": f("critical_oos_count"), "markdowns": f("markdown_risk_count"),
    }
    texts = F.array(*[render(t, **fields) for t in REPORT_LINES])
    summary = kpis.join(trend, DS, "left").select(DS, F.lit("summary").alias("section"), F.posexplode(texts).alias("pos", "line")).withColumn("pos", f("pos") + 1)
    top = top_per(categories, [DS], [F.desc("revenue"), F.asc("category")], REPORT_CATEGORIES)
    part = lambda df, section, line: df.select(DS, F.lit(section).alias("section"), f("rank").cast("int").alias("pos"), line.alias("line"))
    few = lambda df: df.where(f("rank") <= REPORT_ROWS)
    return reduce(DataFrame.unionByName, [
        summary,
        part(top, "categories", render(CATEGORY_LINE, category=f("category"), rev=pounds(f("revenue")), st=known("avg_sell_through", "N/A"),
                                       mg=known("avg_margin_pct", "N/A"), health=f("health"))),
        part(few(reorder), "reorders", render(REORDER_LINE, sku=f("sku"), category=known("category", ""), urgency=f("urgency"), cover=known("cover_weeks", "?"),
                                              st=known("sell_through", "?"))),
        part(few(markdown), "markdowns", render(MARKDOWN_LINE, sku=f("sku"), category=known("category", ""), st=known("sell_through", "?"), severity=f("severity"))),
        part(few(best), "sellers", render(SELLER_LINE, sku=f("sku"), rev=pounds(f("revenue")), st=known("sell_through", "?"))),
    ])


def command_centre(h: DataFrame, actions: DataFrame, memory: DataFrame, moves: DataFrame) -> DataFrame:
    """One row per dataset: health, actions, top opportunity and risk, impact, memory."""
    act = F.struct("rank", F.concat_ws(" — ", "type", "sku").alias("action"), "revenue_impact", "margin_impact", "confidence")
    five = actions.where(F.col("rank") <= 5).groupBy(DS).agg(F.array_sort(F.collect_list(act)).alias("actions"))
    said = memory.groupBy(DS).agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "improved", F.col("text")))).alias("improved"),
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "declined", F.col("text")))).alias("declined"))
    total = health_total()
    base = h.select(DS, total.alias("health_score"), health_label(total).alias("health_label"), "total_revenue", "avg_margin_pct",
                    "avg_sell_through", executive_summary_text().alias("executive_summary"),
                    F.element_at(opportunity_texts(), 1).alias("top_opportunity"), F.element_at(risk_texts(), 1).alias("top_risk"))
    return base.join(commercial_impact(actions, h), DS).join(five, DS).join(said, DS, "left").join(
        moves.select(DS, "rev_delta", "mg_delta", "st_delta", "health_delta"), DS, "left")
