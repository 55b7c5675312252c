"""Sinks: the analysis as tables, the export tables, the audit log, JSON projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.functions.money import fixed, grouped, pounds

DS = "dataset_id"


# Second clustering column of each table: it lets a very large dataset spread over many files.
CLUSTERED_BY = {"sku_rollup": "sku", "best_sellers": "rank", "reorder_alerts": "rank", "markdown_risk": "rank",
                "category_scorecard": "category", "weekly_trend": "week", "channel_split": "channel"}


def publish_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """Write the analysis tables, clustered by dataset.

    Rows are range-clustered rather than put in one folder per dataset: the number of
    datasets grows with the data, and min/max statistics prune as well.
    """
    for name, df in tables.items():
        keys = [DS, *([CLUSTERED_BY[name]] if name in CLUSTERED_BY else [])]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def stored_document(kpis: DataFrame, datasets: DataFrame) -> DataFrame:
    """KPIs and workspace data of each dataset as one JSON text."""
    k = F.struct(*[c for c in kpis.columns if c not in (DS, "role_mask")])
    return kpis.select(DS, k.alias("kpis")).join(datasets.select(DS, "workspace"), DS).select(
        DS, F.to_json(F.struct("kpis", F.col("workspace").alias("_workspace"))).alias("analysis"))


def json_project(documents: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Chosen paths of a JSON column: name -> (path, type)."""
    v = F.try_parse_json(column)
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, *[F.try_variant_get(v, p, t).alias(n) for n, (p, t) in fields.items()])


def export_summary(kpis: DataFrame) -> DataFrame:
    """Ten metric/value rows per dataset."""
    f = F.col
    pct = lambda c: F.concat(fixed(f(c), 1), F.lit("%"))
    margin = lambda c: F.when(f("margin_available"), pct(c)).otherwise("Insufficient data")
    text = lambda c: f(c).cast("string")
    rows = [
        ("Total Revenue", pounds(f("total_revenue"))), ("Total Units", grouped(f("total_units"))),
        ("Gross Profit", pounds(f("gross_profit"))), ("Average Sell-Through", pct("avg_sell_through")),
        ("Average Margin", margin("avg_margin_pct")), ("Blended Gross Margin", margin("gross_margin_pct")),
        ("Average Stock Cover", F.concat(fixed(f("avg_cover_weeks"), 1), F.lit(" weeks"))),
        ("Reorder Alerts", text("reorder_count")), ("Markdown Risk SKUs", text("markdown_risk_count")),
        ("Critical Stockouts", text("critical_oos_count")),
    ]
    structs = [F.struct(F.lit(i + 1).alias("pos"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)]
    return kpis.select(DS, F.inline(F.array(*structs)))


# Columns of the export tables with their labels, in order.
EXPORT_COLUMNS = {
    "Categories": {"category": "Category", "revenue": "Revenue (£)", "units": "Units", "sku_count": "SKUs",
                   "avg_sell_through": "Sell-Through %", "avg_margin_pct": "Margin %", "health": "Health"},
    "Best Sellers": {"sku": "SKU", "name": "Name", "category": "Category", "revenue": "Revenue (£)", "units": "Units",
                     "sell_through": "Sell-Through %", "margin_pct": "Margin %", "stock": "Stock"},
    "Reorder Alerts": {"sku": "SKU", "name": "Name", "category": "Category", "urgency": "Urgency", "revenue": "Revenue (£)",
                       "stock": "Stock", "cover_weeks": "Cover (wks)", "sell_through": "Sell-Through %"},
    "Markdown Risk": {"sku": "SKU", "name": "Name", "category": "Category", "severity": "Severity",
                      "sell_through": "Sell-Through %", "recommended_depth": "Recommended Depth", "revenue": "Revenue (£)"},
}


def export_table(df: DataFrame, title: str) -> DataFrame:
    order = [F.col("rank")] if "rank" in df.columns else []
    return df.select(DS, *order, *[F.col(c).alias(label) for c, label in EXPORT_COLUMNS[title].items()])


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The five export tables as CSV with headers."""
    export_summary(tables["kpis"]).write.mode("overwrite").csv(f"{path}/Summary", header=True)
    sources = {"Categories": "category_scorecard", "Best Sellers": "best_sellers", "Reorder Alerts": "reorder_alerts",
               "Markdown Risk": "markdown_risk"}
    for title, name in sources.items():
        export_table(tables[name], title).write.mode("overwrite").csv(f"{path}/{title}", header=True)


def audit_append(valid: DataFrame, path: str) -> None:
    valid.write.mode("append").parquet(path)
