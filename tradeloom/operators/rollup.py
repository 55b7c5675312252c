"""From trading lines to the tables of the analysis: SKUs, KPIs, categories, weeks, channels.

The only full-size shuffle is the one of ``sku_rollup`` on (dataset_id, sku); all its
aggregates combine map-side, so a hot SKU or a hot dataset reaches a reducer already
reduced. Everything after it works at SKU grain or above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.numbers import exact_mean, parse_number, percent_of
from tradeloom.sources.roles import has_role
from tradeloom.staging import staged

DS = "dataset_id"


def as_percent(column: str, largest: str) -> Column:
    """The column times 100 where its largest value says it holds fractions."""
    fractions = (F.col(largest) > 0) & (F.col(largest) <= 1.5)
    return F.when(fractions, F.round(F.col(column) * 100, 2)).otherwise(F.col(column))


def fix_decimal_percent(lines: DataFrame, columns=("margin_pct", "sell_through")) -> DataFrame:
    """Turn fractions into percentages where a whole column of a dataset holds fractions.

    A column is taken as fractions when its largest value is above 0 and at most 1.5. The
    largest values, one row per dataset, are staged: their real size decides whether they
    are broadcast or joined by a shuffle, in which AQE splits hot datasets.
    """
    largest = staged(lines.groupBy(DS).agg(*[F.max(c).alias(f"max_{c}") for c in columns]), "largest")
    out = lines.join(largest, DS, "left")
    for c in columns:
        out = out.withColumn(c, as_percent(c, f"max_{c}"))
    return out.drop(*[f"max_{c}" for c in columns])


def margin_source(mask: str = "role_mask") -> Column:
    return (
        F.when(has_role("margin_pct", mask), "explicit")
        .when(has_role("margin_value", mask), "margin_value_over_revenue")
        .when(has_role("retail", mask) & has_role("cost", mask), "cost_and_retail")
    )


def derive_margin(lines: DataFrame) -> DataFrame:
    """Margin % from the best source the sheet offers, with ``margin_source``."""
    source = margin_source()
    value = (
        F.when(source == "explicit", F.col("margin_pct").cast("double"))
        .when(source == "margin_value_over_revenue", percent_of(F.col("margin_value"), F.col("revenue")))
        .when(source == "cost_and_retail", percent_of(F.col("retail") - F.col("cost"), F.col("retail")))
    )
    return lines.withColumn("margin_pct", value).withColumn("margin_source", source)


# Columns whose last value in file order counts. Cleaning leaves no gaps in a numeric column
# a sheet has, so the last line of a SKU carries all three.
LAST = ["stock", "sell_through", "cover_weeks"]
FIRST = ["category", "channel", "name", "brand", "buy_qty"]
SUMS = ["units", "revenue", "cost", "full_price_sales", "margin_value"]


def first_values(columns=tuple(FIRST)) -> list[Column]:
    """Aggregates that hold the first value of each column. A line that has them all, the
    usual case, carries its place once; only lines with gaps carry it for every column."""
    placed = F.col("row_id").isNotNull()
    if len(columns) < 2:
        return [F.min(F.when(placed & F.col(c).isNotNull(), F.struct("row_id", c))).alias(f"_{c}") for c in columns]
    gapless = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return [F.min(F.when(gapless & placed, F.struct("row_id", *columns))).alias("_first"),
            *[F.min(F.when(~gapless & placed & F.col(c).isNotNull(), F.struct("row_id", c))).alias(f"_{c}") for c in columns]]


def first_present(column: str, columns=tuple(FIRST)) -> Column:
    """First value of a column from the aggregates of ``first_values``."""
    gapless, other = F.col("_first"), F.col(f"_{column}")
    if len(columns) < 2:
        return other[column].alias(column)
    earlier = other.isNotNull() & (gapless.isNull() | (other["row_id"] < gapless["row_id"]))
    return F.when(earlier, other[column]).otherwise(gapless[column]).alias(column)


def sku_groups(lines: DataFrame, sums=tuple(SUMS), first=tuple(FIRST)) -> DataFrame:
    """One row per dataset and SKU with the chosen sums and first values, and one per dataset for
    its lines without a SKU.

    The SKU leads the grouping because the aggregate sorts by its keys: SKUs differ early,
    dataset names share long prefixes.
    """
    rolled = lines.groupBy("sku", DS).agg(
        *[F.sum(c).alias(c) for c in sums],
        exact_mean(F.col("margin_pct")).alias("margin_pct"),
        F.max_by(F.struct(*LAST), "row_id").alias("last"),
        *first_values(first),
        F.max("role_mask").alias("role_mask"),
    )
    return rolled.select(DS, "sku", *sums, "margin_pct", *[f"last.{c}" for c in LAST], *[first_present(c, first) for c in first], "role_mask")


def sku_rollup(lines: DataFrame) -> DataFrame:
    """One row per dataset and SKU. Lines without a SKU are left out."""
    return sku_groups(lines.where(F.col("sku").isNotNull()))


def rounded_sum(column: str, digits: int = 2) -> Column:
    return F.round(F.sum(column), digits).cast("double")


def margin_present(mask: str = "role_mask") -> Column:
    return margin_source(mask).isNotNull()


def margin_sums() -> list[Column]:
    """Aggregates the blended margin is computed from."""
    weighted = (F.col("margin_pct") * F.col("revenue").cast("double")).try_cast("decimal(38,6)")
    return [
        F.max("role_mask").alias("role_mask"),
        F.sum("revenue").cast("double").alias("_total"),
        F.sum("margin_value").cast("double").alias("_value"),
        F.sum(weighted).cast("double").alias("_weighted"),
        exact_mean(F.col("margin_pct")).alias("_plain"),
    ]


def blended() -> tuple[Column, Column]:
    """Gross margin % and gross profit over the columns of ``margin_sums``: from margin
    values when the sheet has them, else margin % weighted by revenue, else the plain mean."""
    by_value = has_role("margin_value") & (F.col("_total") != 0)
    by_weight = margin_present() & (F.col("_total") != 0)
    ratio = F.try_divide("_weighted", "_total")
    pct = F.when(by_value, F.try_divide("_value", "_total") * 100).when(by_weight, ratio)
    profit = (F.when(by_value, F.col("_value")).when(by_weight, F.col("_total") * ratio / 100)
              .otherwise(F.col("_total") * F.coalesce("_plain", F.lit(0.0)) / 100))
    return F.coalesce(pct, F.lit(0.0)), F.coalesce(profit, F.lit(0.0))


def blended_margin(rollup: DataFrame) -> DataFrame:
    """Unrounded gross margin % and gross profit per dataset."""
    pct, profit = blended()
    return rollup.groupBy(DS).agg(*margin_sums()).select(DS, pct.alias("gross_margin_pct"), profit.alias("gross_profit"))


def dataset_kpis(rollup: DataFrame, *keys: str) -> DataFrame:
    """One row of headline figures per dataset (and value of ``keys``), from a single aggregate.

    Alert counts are conditional sums in it, so no alert table is built or joined and
    counts are those before any top-k cut.
    """
    from tradeloom.operators.alerts import is_markdown, is_reorder, urgency

    mean = lambda c: F.round(F.coalesce(exact_mean(F.col(c)), F.lit(0.0)), 1).alias(f"avg_{c}")
    figures = rollup.groupBy(DS, *keys).agg(
        F.count("*").alias("sku_count"),
        rounded_sum("revenue").alias("total_revenue"),
        F.bround(F.sum("units"), 0).cast("bigint").alias("total_units"),
        mean("sell_through"), mean("margin_pct"), mean("cover_weeks"),
        F.count_if(is_reorder()).alias("reorder_count"),
        F.count_if(is_markdown()).alias("markdown_risk_count"),
        F.count_if(is_reorder() & (urgency() == "CRITICAL")).alias("critical_oos_count"),
        *margin_sums(),
    )
    pct, profit = blended()
    return figures.select(
        DS, "sku_count", "total_revenue", "total_units", F.round(profit, 2).alias("gross_profit"), "avg_sell_through",
        "avg_margin_pct", F.round(pct, 1).alias("gross_margin_pct"), margin_present().alias("margin_available"),
        margin_source().alias("margin_source"), "avg_cover_weeks", "reorder_count", "markdown_risk_count",
        "critical_oos_count", "role_mask", *keys,
    )


def category_scorecard(rollup: DataFrame) -> DataFrame:
    """Revenue, units, mean sell-through and margin, and health per category."""
    from tradeloom.operators.health import category_health

    st = exact_mean(F.col("sell_through"))
    return (
        rollup.where(F.col("category").isNotNull())
        .groupBy(DS, "category")
        .agg(
            rounded_sum("revenue").alias("revenue"),
            F.bround(F.sum("units"), 0).cast("bigint").alias("units"),
            F.count("*").alias("sku_count"),
            st.alias("st"),
            F.round(exact_mean(F.col("margin_pct")), 1).alias("avg_margin_pct"),
        )
        .select(DS, "category", "revenue", "units", "sku_count",
                F.round("st", 1).alias("avg_sell_through"), "avg_margin_pct",
                category_health(F.col("st")).alias("health"))
    )


def weekly_trend(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("week").isNotNull()).groupBy(DS, "week").agg(rounded_sum("revenue").alias("revenue"))


def week_order(week: str = "week") -> Column:
    """Sort key of a week: numbers by value, other labels (dates, names) as text."""
    return F.struct(parse_number(F.trim(week)).alias("number"), F.col(week).alias("label"))


def channel_split(lines: DataFrame, kpis: DataFrame) -> DataFrame:
    """Revenue per channel and its share of the SKU-table total."""
    per = lines.where(F.col("channel").isNotNull()).groupBy(DS, "channel").agg(F.sum("revenue").alias("rev"))
    total = kpis.select(DS, "total_revenue")
    share = F.round(F.coalesce(percent_of(F.round("rev", 2), F.col("total_revenue")), F.lit(0.0)), 1)
    return per.join(total, DS, "left").select(
        DS, "channel", F.round("rev", 2).cast("double").alias("revenue"), share.alias("share_pct"))


def revenue_share(rollup: DataFrame, kpis: DataFrame) -> DataFrame:
    """Each SKU's share of its dataset's revenue in percent."""
    total = kpis.select(DS, "total_revenue")
    return rollup.select(DS, "sku", "revenue").join(total, DS).select(
        DS, "sku", F.round("revenue", 2).cast("double").alias("revenue"),
        F.round(F.coalesce(percent_of(F.col("revenue"), F.col("total_revenue")), F.lit(0.0)), 4).alias("share_pct"))


def asp(kpis: DataFrame) -> DataFrame:
    """Average selling price."""
    return kpis.select(DS, F.round(F.try_divide(F.col("total_revenue"), F.greatest(F.col("total_units"), F.lit(1))), 2).alias("asp"))
