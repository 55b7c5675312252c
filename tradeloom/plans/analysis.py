"""Registered queries: the analysis of trading lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import money, names, numbers
from tradeloom.operators import alerts, health, rollup
from tradeloom.plans import blocks as B
from tradeloom.plans.book import AnalysisBook
from tradeloom.plans.registry import compact, fixed, register
from tradeloom.sources import roles, testtables as tt

book = AnalysisBook.of_test_tables
lines = tt.trading_lines


def rolled(spark, d):
    return rollup.sku_rollup(lines(spark, d))


ROLLUP_OUT = ["units", "revenue", "cost", "full_price_sales", "margin_value", "margin_pct", "stock", "sell_through", "cover_weeks", "buy_qty"]


@register("sku_rollup", f"""
SELECT dataset_id, sku, {', '.join(f'round(cast({c} as double), 6) AS {c}' for c in ROLLUP_OUT)}, category, channel, name, brand FROM sku_rollup""")
def _(spark, d):
    return rolled(spark, d).select("dataset_id", "sku", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ROLLUP_OUT],
                                   "category", "channel", "name", "brand")


@register("best_sellers", "SELECT * FROM best")
def best_sellers(spark, d):
    return alerts.best_sellers(rolled(spark, d))


@register("bottom_sellers", """
SELECT dataset_id, rank2 AS rank, sku, units, revenue FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY units, rank) AS rank2 FROM best)
WHERE rank2 <= 10""")
def _(spark, d):
    return alerts.bottom_sellers(best_sellers(spark, d))


@register("reorder_alerts", "SELECT * FROM reorder")
def _(spark, d):
    return alerts.reorder_alerts(rolled(spark, d))


@register("markdown_risk", "SELECT * FROM markdown")
def _(spark, d):
    return alerts.markdown_risk(rolled(spark, d))


def kpis(spark, d):
    return rollup.dataset_kpis(rolled(spark, d))


@register("dataset_kpis", "SELECT * FROM kpis")
def _(spark, d):
    return kpis(spark, d).drop("role_mask")


@register("blended_margin", f"""
SELECT 'value' AS source, dataset_id, round({B.GM}, 6) AS gross_margin_pct, round(cast(sum(margin_value) as double), 4) AS gross_profit FROM sku_rollup GROUP BY dataset_id
UNION ALL
SELECT 'weighted', dataset_id, round(w / t, 6), round(t * (w / t) / 100, 4) FROM (SELECT dataset_id, cast(sum(revenue) as double) AS t,
  cast(sum(cast(margin_pct * cast(revenue as double) as decimal(38,6))) as double) AS w FROM sku_rollup GROUP BY dataset_id)
UNION ALL
SELECT 'none', dataset_id, 0, 0 FROM sku_rollup GROUP BY dataset_id""")
def _(spark, d):
    """All three branches: margin values, weighted margin %, no margin at all."""
    base = rolled(spark, d)
    no_value = [r for r in roles.ROLES if r != "margin_value"]
    none = [r for r in no_value if r not in ("margin_pct", "cost")]
    bare = base.withColumn("role_mask", F.lit(roles.mask_of(none))).withColumn("margin_pct", F.lit(None).cast("double"))
    variants = {"value": base, "weighted": base.withColumn("role_mask", F.lit(roles.mask_of(no_value))), "none": bare}
    out = None
    for name, df in variants.items():
        part = rollup.blended_margin(df).select(
            F.lit(name).alias("source"), "dataset_id", F.round("gross_margin_pct", 6).alias("gross_margin_pct"),
            F.round("gross_profit", 4).alias("gross_profit"))
        out = part if out is None else out.unionByName(part)
    return out


@register("category_scorecard", "SELECT * FROM cats")
def _(spark, d):
    return rollup.category_scorecard(rolled(spark, d))


@register("category_health", "SELECT health, count(*) AS categories FROM cats GROUP BY health")
def _(spark, d):
    return rollup.category_scorecard(rolled(spark, d)).groupBy("health").agg(F.count("*").alias("categories"))


@register("weekly_trend", "SELECT * FROM weekly")
def _(spark, d):
    return rollup.weekly_trend(lines(spark, d))


@register("channel_split", """
SELECT c.dataset_id, channel, cast(round(rev, 2) as double) AS revenue,
  round(cast(round(rev, 2) as double) / total_revenue * 100, 1) AS share_pct
FROM (SELECT dataset_id, channel, sum(revenue) AS rev FROM trading_lines GROUP BY 1, 2) c JOIN kpis k ON k.dataset_id = c.dataset_id""")
def _(spark, d):
    base = lines(spark, d)
    return rollup.channel_split(base, rollup.dataset_kpis(rollup.sku_rollup(base)))


@register("revenue_share", """
SELECT r.dataset_id, sku, cast(round(r.revenue, 2) as double) AS revenue, round(cast(r.revenue as double) / total_revenue * 100, 4) AS share_pct
FROM sku_rollup r JOIN kpis k ON k.dataset_id = r.dataset_id""")
def _(spark, d):
    b = book(spark, d).prepare("rollup", "kpis")
    return rollup.revenue_share(b.rollup, b.kpis)


@register("asp", "SELECT dataset_id, round(total_revenue / greatest(total_units, 1), 2) AS asp FROM kpis")
def _(spark, d):
    return rollup.asp(kpis(spark, d))


# Messy cells made from prices: one shape per order key.
MESSY_SQL = """case l_orderkey % 8 when 0 then '£' || p when 1 then '$ ' || p when 2 then p || '%' when 3 then 'N/A' when 4 then '-'
  when 5 then '(' || p || ')' when 6 then p || 'd' else ' 1,' || p end"""


def messy(spark, d):
    p = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    shapes = [F.concat(F.lit("£"), p), F.concat(F.lit("$ "), p), F.concat(p, F.lit("%")), F.lit("N/A"), F.lit("-"),
              F.concat(F.lit("("), p, F.lit(")")), F.concat(p, F.lit("d"))]
    cell = F.concat(F.lit(" 1,"), p)
    for i, shape in enumerate(shapes):
        cell = F.when(F.pmod("l_orderkey", F.lit(8)) == i, shape).otherwise(cell)
    return tt.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cell.alias("cell"))


@register("clean_numeric", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, case when bare in ('nan', 'None', '', '-', 'N/A', 'n/a') then cast(0 as double)
  when regexp_full_match(bare, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then cast(bare as double) else cast(0 as double) end AS value
FROM (SELECT *, regexp_replace(regexp_replace(cell, '[£$€¥₹,\\s]', '', 'g'), '%$', '') AS bare
  FROM (SELECT *, {MESSY_SQL} AS cell FROM (SELECT *, cast(cast(l_extendedprice as decimal(12,2)) as varchar) AS p FROM lineitem)))""")
def _(spark, d):
    return messy(spark, d).withColumn("value", numbers.clean_numeric(F.col("cell")))


@register("fix_decimal_percent", """
SELECT t.dataset_id, t.sku, t.row_id.o AS l_orderkey, t.row_id.n AS l_linenumber,
  case when m.margin > 0 and m.margin <= 1.5 then round(t.margin * 100, 2) else t.margin end AS margin_pct,
  case when m.st > 0 and m.st <= 1.5 then round(t.st * 100, 2) else t.st end AS sell_through, t.revenue_d AS revenue
FROM (SELECT *, cast(revenue as double) AS revenue_d, case when cast(split_part(dataset_id, ':', 2) as int) % 2 = 0 then margin_pct / 100 else margin_pct end AS margin,
    case when cast(split_part(dataset_id, ':', 2) as int) % 3 = 0 then sell_through / 100 else sell_through end AS st FROM trading_lines) t
JOIN (SELECT dataset_id, max(case when cast(split_part(dataset_id, ':', 2) as int) % 2 = 0 then margin_pct / 100 else margin_pct end) AS margin,
    max(case when cast(split_part(dataset_id, ':', 2) as int) % 3 = 0 then sell_through / 100 else sell_through end) AS st FROM trading_lines GROUP BY 1) m
ON m.dataset_id = t.dataset_id""")
def _(spark, d):
    """Every second dataset carries margins as fractions, every third sell-through."""
    y = F.element_at(F.split("dataset_id", ":"), 2).cast("int")
    part = lambda c, n: F.when(F.pmod(y, F.lit(n)) == 0, F.col(c) / 100).otherwise(F.col(c))
    raw = lines(spark, d).withColumn("margin_pct", part("margin_pct", 2)).withColumn("sell_through", part("sell_through", 3))
    return rollup.fix_decimal_percent(raw).select(
        "dataset_id", "sku", "row_id.l_orderkey", "row_id.l_linenumber", "margin_pct", "sell_through", F.col("revenue").cast("double").alias("revenue"))


@register("derive_margin", """
SELECT dataset_id, sku, cast(revenue as double) AS revenue, case y % 3 when 0 then 'explicit' when 1 then 'margin_value_over_revenue' else 'cost_and_retail' end AS margin_source,
  round(case y % 3 when 0 then margin_pct when 1 then cast(margin_value as double) / cast(revenue as double) * 100
    else cast(retail - cost as double) / cast(retail as double) * 100 end, 6) AS margin_pct
FROM (SELECT *, cast(split_part(dataset_id, ':', 2) as int) AS y FROM trading_lines)""")
def _(spark, d):
    """The sheets of a year lack the columns that would decide in another year."""
    y = F.pmod(F.element_at(F.split("dataset_id", ":"), 2).cast("int"), F.lit(3))
    less = lambda *gone: F.lit(roles.mask_of(r for r in roles.ROLES if r not in gone))
    mask = F.when(y == 0, F.lit(roles.ALL_ROLES)).when(y == 1, less("margin_pct")).otherwise(less("margin_pct", "margin_value"))
    return rollup.derive_margin(lines(spark, d).withColumn("role_mask", mask)).select(
        "dataset_id", "sku", F.col("revenue").cast("double").alias("revenue"), "margin_source", F.round("margin_pct", 6).alias("margin_pct"))


@register("safe_float", """
SELECT event_id, coalesce(try_cast(case event_id % 3 when 0 then cast(value as varchar) when 1 then 'nothing' end as double), 0) AS value FROM events""")
def _(spark, d):
    text = F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("value").cast("string")).when(F.pmod("event_id", F.lit(3)) == 1, "nothing")
    return tt.table(spark, d, "events").select("event_id", numbers.safe_float(text).alias("value"))


@register("gbp_compact", f"""
SELECT o_orderkey, {compact("cast(o_totalprice as double) * [0.001, 1, 100][o_orderkey % 3 + 1]")} AS label FROM orders""")
def _(spark, d):
    factor = F.element_at(F.array(F.lit(0.001), F.lit(1.0), F.lit(100.0)), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return tt.table(spark, d, "orders").select("o_orderkey", money.gbp_compact(F.col("o_totalprice") * factor).alias("label"))


NAMED_SQL = """SELECT o_orderkey, ['plan_', 'Buy-Plan ', 'CLEARANCE.', 'supplier', 'stocklist', 'assortment', 'wk'][o_orderkey % 7 + 1] || o_orderkey ||
  ['.csv', '.XLSX', '.xls', '.numbers', '.ods', '.tsv', '.txt', '.pdf', ''][o_orderkey % 9 + 1] AS filename,
  case when o_orderkey % 5 = 0 then ['Sourcing'] else ['season'] end AS tags FROM orders"""


def named_files(spark, d):
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod("o_orderkey", F.lit(n)) + 1).cast("int"))
    stem = pick(["plan_", "Buy-Plan ", "CLEARANCE.", "supplier", "stocklist", "assortment", "wk"], 7)
    ext = pick([".csv", ".XLSX", ".xls", ".numbers", ".ods", ".tsv", ".txt", ".pdf", ""], 9)
    return tt.table(spark, d, "orders").select(
        "o_orderkey", F.concat(stem, F.col("o_orderkey").cast("string"), ext).alias("filename"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.array(F.lit("Sourcing"))).otherwise(F.array(F.lit("season"))).alias("tags"))


@register("file_type", f"""
SELECT o_orderkey, filename, case ext when 'csv' then 'CSV' when 'xlsx' then 'Excel' when 'xls' then 'Excel' when 'numbers' then 'Numbers'
  when 'ods' then 'Spreadsheet' when 'tsv' then 'TSV' when 'txt' then 'Text' when '' then 'File' else upper(ext) end AS file_type
FROM (SELECT *, case when contains(filename, '.') then lower(string_split(filename, '.')[-1]) else '' end AS ext FROM ({NAMED_SQL}))""")
def _(spark, d):
    return named_files(spark, d).select("o_orderkey", "filename", names.file_type(F.col("filename")).alias("file_type"))


@register("dataset_type", f"""
SELECT o_orderkey, case when hay like '%buy%' and hay like '%plan%' then 'Buy Plan' when hay like '%markdown%' or hay like '%clearance%' then 'Markdown Plan'
  when hay like '%supplier%' or hay like '%sourcing%' then 'Supplier Report' when hay like '%stock%' or hay like '%inventory%' then 'Stock Report'
  when hay like '%range%' or hay like '%assortment%' then 'Range Plan' else 'Trading Report' end AS dataset_type
FROM (SELECT *, lower(filename || ' ' || array_to_string(tags, ' ')) AS hay FROM ({NAMED_SQL}))""")
def _(spark, d):
    return named_files(spark, d).select("o_orderkey", names.dataset_type(F.col("filename"), F.col("tags")).alias("dataset_type"))


@register("role_map", """
SELECT c_custkey, coalesce(case label when 'Assistant Merchandiser' then 'MA' when 'Merchandising Assistant' then 'MA' when 'Merchandiser' then 'Merchandiser'
  when 'Freelancer' then 'Merchandiser' when 'Consultant' then 'Director' end, 'AM') AS role
FROM (SELECT c_custkey, ['Assistant Merchandiser', 'Merchandising Assistant', 'Merchandiser', 'Freelancer', 'Consultant', 'Owner', ''][c_custkey % 7 + 1] AS label FROM customer)""")
def _(spark, d):
    labels = F.array(*[F.lit(x) for x in (*names.ONBOARDING_ROLES, "Owner", "")])
    label = F.element_at(labels, (F.pmod("c_custkey", F.lit(7)) + 1).cast("int"))
    return tt.table(spark, d, "customer").select("c_custkey", names.onboarding_role(label).alias("role"))


# Health and verdict rules over the KPI rows.

HEALTH_ROWS = [("revenue", "Revenue Performance", 30), ("sell_through", "Sell-Through", 20), ("margin", "Margin Protection", 20),
               ("stock", "Stock Efficiency", 20), ("risk", "Risk Exposure", 10)]
HEALTH_DETAIL = {
    "revenue": f"'Revenue quality from ' || {fixed('st', 0)} || '% sell-through and ' || {fixed('mg', 0)} || '% margin.'",
    "sell_through": f"'Range sell-through of ' || {fixed('st', 1)} || '% — how fast stock is converting.'",
    "margin": f"'Blended margin of ' || {fixed('mg', 1)} || '% vs a 55% healthy benchmark.'",
    "stock": f"case when cover <= 0 then 'No stock-cover signal in this dataset.' else {fixed('cover', 1)} || ' wks cover — ' || case when cover < 4 then "
             "'running lean, stockout risk on top sellers.' when cover <= 8 then 'healthy, within the ideal 4-8 wk band.' else 'overstocked, cash tied up in slow stock.' end end",
    "risk": "case when critical_oos_count + reorder_count + markdown_risk_count = 0 then 'No critical stock or margin risks detected.' else 'Live risks: ' || concat_ws(', ', "
            "case when critical_oos_count <> 0 then critical_oos_count || ' critical OOS' end, case when reorder_count <> 0 then reorder_count || ' reorder alerts' end, "
            "case when markdown_risk_count <> 0 then markdown_risk_count || ' markdown risks' end) || '.' end",
}


@register("health_breakdown", " UNION ALL ".join(f"""
SELECT dataset_id, health AS total, case when health >= 80 then 'Healthy' when health >= 60 then 'Watch' else 'At Risk' end AS label,
  '{k}' AS component, '{t}' AS name, p_{k} AS score, {m} AS max_score,
  case when cast(p_{k} as double) / {m} >= 0.75 then 'strong' when cast(p_{k} as double) / {m} >= 0.45 then 'watch' else 'weak' end AS status,
  {HEALTH_DETAIL[k]} AS detail FROM scored""" for k, t, m in HEALTH_ROWS))
def _(spark, d):
    return health.health_breakdown(kpis(spark, d))


@register("legacy_health_score", """
SELECT dataset_id, case when st >= 50 then 25 when st >= 35 then 20 when st >= 20 then 12 else 5 end
  + case when m >= 55 then 25 when m >= 40 then 20 when m >= 25 then 12 else 5 end
  + case when c between 4 and 8 then 25 when (c >= 2 and c < 4) or (c > 8 and c <= 12) then 18 when c >= 1 and c < 2 then 10 else 3 end
  + case when r = 0 then 25 when r <= 3 then 20 when r <= 10 then 12 else 5 end AS score
FROM (SELECT dataset_id, avg_sell_through AS st, avg_margin_pct AS m, avg_cover_weeks AS c, reorder_count AS r FROM kpis)""")
def _(spark, d):
    f = F.col
    score = health.legacy_health_score(f("avg_sell_through"), f("avg_margin_pct"), f("avg_cover_weeks"), f("reorder_count"))
    return kpis(spark, d).select("dataset_id", score.alias("score"))


@register("category_health_score", """
SELECT dataset_id, category, case when st = 0 and mg = 0 then 0 else cast(round_even(greatest(0, least(100,
  least(st, 100) / cast(100 as double) * 55 + least(mg, 60) / cast(60 as double) * 45)), 0) as int) end AS health
FROM (SELECT *, coalesce(avg_sell_through, 0) AS st, coalesce(avg_margin_pct, 0) AS mg FROM cats)""")
def _(spark, d):
    return rollup.category_scorecard(rolled(spark, d)).select(
        "dataset_id", "category", health.category_health_score(F.col("avg_sell_through"), F.col("avg_margin_pct")).alias("health"))


@register("key_recommendation", """
SELECT dataset_id, case when avg_sell_through >= 70 then 'Reorder best-sellers — strong sell-through, protect availability'
  when avg_sell_through < 45 then 'Trigger early markdown on slow stock to release cash'
  when avg_margin_pct < 40 then 'Review pricing & markdown depth to protect margin' else 'Hold and monitor — trading in line with plan' end AS key_rec FROM kpis""")
def _(spark, d):
    return kpis(spark, d).select("dataset_id", health.key_recommendation(F.col("avg_sell_through"), F.col("avg_margin_pct")).alias("key_rec"))


@register("trading_verdict", """
SELECT dataset_id, case when avg_sell_through >= 45 and avg_margin_pct >= 45 then 'positive' when avg_sell_through < 25 then 'under pressure' else 'mixed' end AS verdict FROM kpis""")
def _(spark, d):
    return kpis(spark, d).select("dataset_id", health.trading_verdict(F.col("avg_sell_through"), F.col("avg_margin_pct")).alias("verdict"))
