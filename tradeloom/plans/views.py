"""Registered queries: role view, action centre, category drill-down, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeloom.functions.templates import ACTION_TEXTS, TEXT_FIELDS
from tradeloom.operators import actions, category, reports, role_view, timeline
from tradeloom.plans.book import STORED, AnalysisBook
from tradeloom.plans.registry import CTES, compact, fixed, grouped, pounds, register, text, whole
from tradeloom.sources import publish, testtables as tt
from tradeloom.sources.store import AnalysisStore
from tradeloom.staging import scratch, shuffles_freed, staged

# Report and action wording in the SQL below is that of the results.
book = AnalysisBook.of_test_tables

# ---- role view -----------------------------------------------------------------------


@register("role_metrics", """
SELECT dataset_id, cast(round_even(stock_units, 0) as bigint) AS total_stock_units, round(total_revenue * 0.5 / 12, 2) AS total_stock_value, missing_data_count,
  round(cast(sku_count - missing_data_count as double) / greatest(sku_count, 1) * 100, 1) AS data_quality_pct, open_po_count, open_po_value FROM firsts""")
def _(spark, d):
    return role_view.role_metrics(book(spark, d).heads)


@register("plan_vs_actual", """
SELECT dataset_id, revenue_plan, margin_plan, stock_plan, round(total_revenue / revenue_plan * 100, 1) AS revenue_pct,
  round(avg_margin_pct / margin_plan * 100, 1) AS margin_pct, round(units / greatest(stock_plan, 1) * 100, 1) AS stock_pct
FROM (SELECT *, round(total_revenue * 1.05, 2) AS revenue_plan, round(avg_margin_pct * 1.08, 1) AS margin_plan, round_even(round_even(stock_units, 0) * 0.92, 0) AS stock_plan,
  round_even(stock_units, 0) AS units FROM firsts)""")
def _(spark, d):
    return role_view.plan_vs_actual(book(spark, d).heads)


def slot(rank, kind, sku, description, revenue, margin, confidence, priority):
    return (f"{{'slot': {rank}, 'type': '{kind}', 'sku': {sku}, 'description': {description}, 'revenue_impact': round_even({revenue}, 0), "
            f"'margin_impact': cast({margin} as double), 'confidence': {confidence}, 'priority': {priority}}}")


RECOMMENDED = "'Recommended'"
SLOTS = [
    f"case when md1_sku is not null then {slot(1, 'Markdown', 'md1_sku', text('Reduce price {d} to clear excess stock and free working capital', d='md1_depth'), 'md1_rev * 0.3', -8.5, 87, chr(39).join(['case when md1_sev = ', 'CLEARANCE', ' then ', 'Critical', ' else ', 'Urgent', ' end']))} end",
    f"case when ro1_sku is not null then {slot(2, 'Reorder', 'ro1_sku', text('Replenish immediately to maintain 6-week cover and protect revenue'), 'ro1_rev * 1.2', 2.3, 92, chr(39).join(['case when ro1_urgency = ', 'CRITICAL', ' then ', 'Critical', ' else ', 'Urgent', ' end']))} end",
    f"case when md2_sku is not null then {slot(3, 'Markdown', 'md2_sku', text('Tactical {d} price reduction to stimulate demand', d='md2_depth'), 'md2_rev * 0.15', -4.2, 79, chr(39).join(['case when md2_sev = ', 'TACTICAL', ' then ', 'Recommended', ' else ', 'Urgent', ' end']))} end",
    f"case when weak_cat is not null then {slot(4, 'Cancel PO', 'weak_cat', text('Review and reduce forward orders for {c} — low sell-through signals weak demand', c='weak_cat'), 'weak_rev * -0.1', 3.1, 74, RECOMMENDED)} "
    f"when ro2_sku is not null then {slot(4, 'Reorder', 'ro2_sku', text('Secondary replenishment — prevent stockout before next delivery window'), 'ro2_rev * 0.8', 1.8, 85, repr('Urgent'))} end",
    f"case when strong_cat is not null then {slot(5, 'Monitor', 'strong_cat', text('Accelerate {c} intake — strong sell-through of {st}% signals untapped demand', c='strong_cat', st=fixed('strong_st', 0)), 'strong_rev * 0.25', 1.5, 81, RECOMMENDED)} "
    f"else {slot(5, 'Monitor', 'best_sku', text('Monitor best sellers daily — high velocity risks stockout without adequate cover'), 'total_revenue * 0.05', 0.5, 76, RECOMMENDED)} end",
    slot(6, "Reorder", "'OTB Review'", text("Reallocate OTB from underperforming categories to top performers — estimated {m}% margin uplift available", m=fixed("avg_margin_pct", 0)), "total_revenue * 0.08", 2.0, 70, RECOMMENDED),
]
REVIEWS = ", ".join(slot(7 + i, "Monitor", "'Range Review'", text("Conduct weekly range review to identify emerging trends and risks"), "cast(0 as double)", 0, 65, RECOMMENDED) for i in range(6))
CTES["role_actions"] = f"""
  SELECT dataset_id, rank, s.type AS type, s.sku AS sku, s.description AS description, s.revenue_impact AS revenue_impact, s.margin_impact AS margin_impact,
    s.confidence AS confidence, s.priority AS priority
  FROM (SELECT dataset_id, s, row_number() OVER (PARTITION BY dataset_id ORDER BY s.slot) AS rank
    FROM (SELECT dataset_id, unnest([{', '.join(SLOTS)}, {REVIEWS}]) AS s FROM firsts) WHERE s IS NOT NULL) WHERE rank <= 6"""


@register("role_actions", "SELECT * FROM role_actions")
def _(spark, d):
    return book(spark, d).role_actions


@register("commercial_impact", """
SELECT k.dataset_id, cast(round_even(abs(down), 0) as bigint) AS revenue_at_stake, cast(round_even(total_revenue * 0.04, 0) as bigint) AS margin_protect,
  cast(round_even(up, 0) as bigint) AS total_upside
FROM kpis k JOIN (SELECT dataset_id, sum(greatest(revenue_impact, 0)) AS up, sum(least(revenue_impact, 0)) AS down FROM role_actions GROUP BY 1) a USING (dataset_id)""")
def _(spark, d):
    b = book(spark, d)
    return role_view.commercial_impact(b.role_actions, b.kpis)


WHY = f"""case source when 'markdown' then {text('{s} is selling at just {st}% — ', s='sku', st=fixed('md_st', 0))} ||
    case when category_avg_st is not null then {text('well below the {c} category average of {a}%', c='item_category', a=fixed('category_avg_st', 0))}
      else {text('below the {a}% range average', a=fixed('avg_st', 0))} end ||
    {text('. Acting now releases {v} of trapped stock before it ages further.', v=compact('md_rev'))}
  when 'reorder' then {text('{s} has only {c} weeks of cover left against {st}% sell-through, putting {v} of demand at risk if it stocks out before the next delivery.',
                            s='sku', c=fixed('ro_cover', 1), st=fixed('ro_st', 0), v=compact('ro_rev'))}
  when 'category' then case when cat_st < avg_st then {text('{s} is rated {h} with {c}% sell-through, below the {a}% range average — trimming forward commitment protects margin.',
                            s='sku', h="case cat_health when 'AT RISK' then 'At Risk' else upper(cat_health[1]) || lower(cat_health[2:]) end", c=fixed('cat_st', 0), a=fixed('avg_st', 0))}
    else {text('{s} is your strongest category at {v} revenue and {c}% sell-through — leaning in captures demand outpacing supply.', s='sku', v=compact('cat_rev'), c=fixed('coalesce(cat_st, 0)', 0))} end
  else description end"""
TITLE = "(case {0} when 'AT RISK' then 'At Risk' else upper({0}[1]) || lower({0}[2:]) end)"
POINTS = f"""case source when 'markdown' then concat_ws('; ', 'Sell-through=' || {fixed('md_st', 0)} || '%',
    coalesce(item_category || ' avg ST=' || {fixed('category_avg_st', 0)} || '%', 'Range avg ST=' || {fixed('avg_st', 0)} || '%'),
    'Stock value tied up=' || {compact('md_rev')}, 'Recommended depth=' || md_depth)
  when 'reorder' then concat_ws('; ', 'Weeks of cover=' || {fixed('ro_cover', 1)} || ' wks', 'Sell-through=' || {fixed('ro_st', 0)} || '%',
    'Stock on hand=' || {grouped('ro_stock')} || ' units', 'Revenue at risk=' || {compact('ro_rev')}, 'Urgency=' || {TITLE.format('ro_urgency')})
  when 'category' then concat_ws('; ', 'Category revenue=' || {compact('cat_rev')}, 'Avg sell-through=' || {fixed('cat_st', 0)} || '%',
    'Health=' || {TITLE.format('cat_health')}, 'SKUs in range=' || cat_skus)
  else concat_ws('; ', 'Range avg ST=' || {fixed('avg_st', 0)} || '%', 'Range avg cover=' || {fixed('avg_cover', 1)} || ' wks', case when bs_rev is not null then sku || ' revenue=' || {compact('bs_rev')} end) end"""


@register("action_evidence", f"""
SELECT dataset_id, rank, type, sku, source, item_category, category_avg_st, confidence, revenue_impact,
  case when revenue_impact >= 0 then 'Revenue recovered' else 'Revenue traded' end AS revenue_label, margin_impact, {WHY} AS why, {POINTS} AS data_points
FROM (SELECT a.*, case when m.sku is not null then 'markdown' when r.sku is not null then 'reorder' when c.category is not null then 'category' else 'generic' end AS source,
    coalesce(m.category, r.category, s.category) AS item_category, i.avg_sell_through AS category_avg_st, k.avg_sell_through AS avg_st, k.avg_cover_weeks AS avg_cover,
    m.sell_through AS md_st, m.revenue AS md_rev, m.recommended_depth AS md_depth, r.cover_weeks AS ro_cover, r.sell_through AS ro_st, r.stock AS ro_stock, r.revenue AS ro_rev, r.urgency AS ro_urgency,
    c.avg_sell_through AS cat_st, c.revenue AS cat_rev, c.health AS cat_health, c.sku_count AS cat_skus, s.revenue AS bs_rev
  FROM role_actions a JOIN kpis k ON k.dataset_id = a.dataset_id
  LEFT JOIN markdown m ON m.dataset_id = a.dataset_id AND m.sku = a.sku LEFT JOIN reorder r ON r.dataset_id = a.dataset_id AND r.sku = a.sku
  LEFT JOIN cats c ON c.dataset_id = a.dataset_id AND c.category = a.sku LEFT JOIN best s ON s.dataset_id = a.dataset_id AND s.sku = a.sku
  LEFT JOIN cats i ON i.dataset_id = a.dataset_id AND i.category = coalesce(m.category, r.category, s.category))""")
def _(spark, d):
    b = book(spark, d).prepare(*STORED)
    return role_view.action_evidence(b.role_actions, b.markdown_risk, b.reorder_alerts, b.categories, b.best_sellers, b.kpis)


RISKS = [
    f"case when md1_sku is not null then {text('{n} SKUs at markdown risk — {sku} has only {st}% sell-through, risking {rev} revenue', n='markdown_rows', sku='md1_sku', st=fixed('md1_st', 0), rev=pounds('md1_rev'))} "
    "else 'Monitor sell-through weekly — low ST can quickly escalate to markdown territory' end",
    f"case when avg_cover_weeks > 12 then {text('Average stock cover of {c} weeks is above target — overstocked range risks cash and margin', c=fixed('avg_cover_weeks', 1))} "
    f"when avg_cover_weeks < 3 then {text('Average stock cover of {c} weeks is critically low — risk of lost sales across the range', c=fixed('avg_cover_weeks', 1))} "
    f"when reorder_count > 5 then {text('{n} SKUs need urgent reordering — risk of stockouts impacting revenue momentum', n='reorder_count')} "
    "else 'Margin erosion risk if markdown depth increases — review pricing strategy' end",
    f"case when weak_cat is not null then {text('{n} categories rated AT RISK or CRITICAL — {c} needs immediate attention with {rev} revenue exposed', n='weak_count', c='weak_cat', rev=pounds('weak_rev'))} "
    f"else {text('Gross margin at {m}% — if this falls below 40% it will impact profitability targets', m=fixed('avg_margin_pct', 1))} end",
]
CTES["risks"] = f"SELECT dataset_id, [{', '.join(RISKS)}] AS risks FROM firsts"


@register("top_risks", "SELECT dataset_id, unnest([1, 2, 3]) AS pos, unnest(risks) AS risk FROM risks")
def _(spark, d):
    return role_view.top_risks(book(spark, d).heads)


OPPORTUNITIES = [
    f"case when strong_cat is not null then {text('Accelerate intake in {c} — strong sell-through of {st}% signals demand outpacing supply', c='strong_cat', st=fixed('strong_st', 0))} "
    f"else {text('Focus buying power on top performers — best sellers driving {rev} each', rev=pounds('best_rev'))} end",
    f"case when reorder_count > 0 then {text('Rapid replenishment of {n} critical/urgent SKUs could unlock {v} in additional revenue over 6 weeks', n='open_po_count', v=pounds('open_po_value * 6'))} "
    "else 'Strong stock position — opportunity to negotiate better terms with suppliers given healthy cover' end",
    f"case when avg_margin_pct > 45 then {text('Gross margin at {m}% is above benchmark — explore premium pricing on hero SKUs to further improve profitability', m=fixed('avg_margin_pct', 1))} "
    "else 'Markdown execution on slow movers will release working capital and improve overall range margin' end",
]


@register("top_opportunities", f"SELECT dataset_id, unnest([1, 2, 3]) AS pos, unnest([{', '.join(OPPORTUNITIES)}]) AS opportunity FROM firsts")
def _(spark, d):
    return role_view.top_opportunities(book(spark, d).heads)


PLAN_PCT = "round(total_revenue / round(total_revenue * 1.05, 2) * 100, 1)"


@register("executive_summary", f"""
SELECT dataset_id, concat_ws(' ', 'Trading is performing ' || case when {PLAN_PCT} >= 100 then 'above' else 'below' end || ' plan at ' || {fixed(PLAN_PCT, 0)} || '% of revenue target.',
  {text('{c} is the top performing category at {rev} revenue', c='top_cat', rev=pounds('top_rev'))} || case when coalesce(top_st, 0) <> 0 then {text(' and {st}% sell-through.', st=fixed('top_st', 0))} else '.' end,
  {text('{c} is flagged as {h} with only {st}% sell-through — immediate action required.', c='weak_cat', h='weak_health', st=fixed('weak_st', 0))},
  case when critical_oos_count > 0 then {text('{n} SKUs are critically out-of-stock — emergency reorder recommended to prevent further revenue loss.', n='critical_oos_count')}
    when reorder_count > 0 then {text('{n} SKUs require reorder action to maintain adequate cover across the range.', n='reorder_count')} end,
  case when avg_margin_pct > 0 then case when markdown_rows > 3 then 'Prioritise markdown execution' else 'Maintain pricing discipline' end ||
    ' to optimise margin by approximately ' || {fixed('round((avg_margin_pct * 1.05 - avg_margin_pct) / avg_margin_pct * 100, 1)', 1)} || '% over the next 4 weeks.' end) AS executive_summary
FROM firsts""")
def _(spark, d):
    return role_view.executive_summary(book(spark, d).heads)


@register("extremes", "SELECT dataset_id, top_cat AS top_category, weak_cat AS risk_category, best_sku AS top_sku, critical_sku, md1_sku AS top_markdown_sku FROM firsts")
def _(spark, d):
    return role_view.extremes(book(spark, d).heads)


@register("quick_insights_fallback", f"""
SELECT dataset_id, unnest([1, 2, 3]) AS pos, unnest([
  {text('Raise POs immediately for {n} out-of-stock SKUs before revenue is lost.', n='critical_oos_count')},
  {text('Review {n} slow-selling SKUs for tactical markdowns to protect margin.', n='markdown_risk_count')},
  {text("Overall sell-through of {st}% indicates overbought range — tighten next season's OTB.", st=fixed('avg_sell_through', 1))}]) AS insight FROM kpis""")
def _(spark, d):
    return role_view.quick_insights(book(spark, d).kpis)


@register("sparkline", """
SELECT dataset_id, point, round(value, 2) AS value FROM (
  SELECT dataset_id, n, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS point,
    unnest([case when i <= 8 - n then got[1] * pow(0.95, 8 - n - i + 1) else got[i - 8 + n] end for i in [1, 2, 3, 4, 5, 6, 7, 8]]) AS value
  FROM (SELECT dataset_id, count(*) AS n, list(revenue ORDER BY week) AS got
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY week DESC) AS r FROM weekly) WHERE r <= 8 GROUP BY 1))""")
def _(spark, d):
    b = book(spark, d).prepare("kpis", "weekly")
    return role_view.sparkline(b.kpis, b.weekly)


@register("trend_direction", """
SELECT dataset_id, case when n >= 2 and l > f then 'improving' when n >= 2 and l < f then 'declining' else 'stable' end AS trend
FROM (SELECT dataset_id, count(*) AS n, arg_min(revenue, week) AS f, arg_max(revenue, week) AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY week DESC) AS r FROM weekly) WHERE r <= 6 GROUP BY 1)""")
def _(spark, d):
    return role_view.trend_direction(book(spark, d).weekly)


# ---- action centre -------------------------------------------------------------------

TOTALS = "JOIN (SELECT dataset_id AS kd, greatest(total_revenue, 1) AS total_rev, avg_margin_pct AS avg_margin FROM kpis) k ON k.kd = t.dataset_id"
TEXT_MAP = {"category": "cat_name", "sku": "sku_name", "margin": "x_margin", "amount": "x_amount", "cash": "x_cash", "st": "x_st", "cover": "x_cover",
            "grade": "x_grade", "depth": "x_depth", "source": "x_source", "target": "x_target"}


def kind(name, order, seq, sku, cat, label, score, revenue, margin_pts, cash_out, confidence, rows_sql, **texts):
    """One action type as SQL: numbers in the inner select, texts around it."""
    extra = {"margin": fixed("avg_margin", 0), "st": "''", "cover": "''", "grade": "''", "depth": "''", "source": "''", "target": "''"}
    amount = texts.pop("amount", pounds("revenue_impact"))
    extra.update(texts)
    aliases = ", ".join(f"{v} AS x_{k}" for k, v in extra.items())
    wording = ", ".join(f"{text(ACTION_TEXTS[name][t], **TEXT_MAP)} AS {t}" for t in TEXT_FIELDS)
    return f"""SELECT dataset_id, '{name}' AS type, priority_label, cast(priority_score as int) AS priority_score, sku_name AS sku, cat_name AS category,
      cast(revenue_impact as double) AS revenue_impact, cast(margin_impact as double) AS margin_impact, cast(cash_recovery as double) AS cash_recovery,
      cast(confidence as int) AS confidence, {order} AS type_order, cast(seq as double) AS seq, {wording}
    FROM (SELECT *, {amount} AS x_amount, {pounds('cash_recovery')} AS x_cash FROM (
      SELECT t.*, total_rev, avg_margin, {sku} AS sku_name, {cat} AS cat_name, {label} AS priority_label, {score} AS priority_score, {revenue} AS revenue_impact,
        {margin_pts} AS margin_impact, {cash_out} AS cash_recovery, {confidence} AS confidence, {seq} AS seq, {aliases} FROM ({rows_sql}) t {TOTALS}))"""


def graded(column, first, second, values):
    return f"(case {column} when '{first}' then {values[0]} when '{second}' then {values[1]} else {values[2]} end)"


def points(limit, *terms):
    return f"least({limit}, trunc({' + '.join(terms)}))"


D = lambda n: f"cast({n} as double)"
sev = lambda *v: graded("severity", "CLEARANCE", "DEEP", v)
urg = lambda *v: graded("urgency", "CRITICAL", "URGENT", v)
md_cash = whole(f"t.revenue * (1 - avg_margin / {D(100)}) * greatest({D(1)}, (100 - t.sell_through) / {D(50)}) * ({sev(45, 30, 18)} / {D(100)}) * {D(0.82)}")
ro_cover = f"(case when coalesce(t.cover_weeks, 0) = 0 then {D(3)} else t.cover_weeks end)"
ro_st = f"(case when coalesce(t.sell_through, 0) = 0 then {D(72)} else t.sell_through end)"
crit = lambda a, b: f"(case when t.health = 'CRITICAL' then {a} else {b} end)"
saving = whole("t.revenue * 0.22")
moved = f"round_even(least(t.src_rev, t.dst_rev) * {D(0.09)}, 0)"
gap = f"greatest({D(0)}, 48 - t.avg_margin_pct)"
gain = f"round_even(t.revenue * {gap} / {D(100)}, 0)"
LEVEL = "'Category Level'"
KINDS = {
    "Markdown": kind(
        "Markdown", 1, "t.rank", "t.sku", "coalesce(t.category, 'General')", sev("'Critical'", "'High'", "'Medium'"),
        points(99, f"least({D(30)}, t.revenue / total_rev * 3000)", f"(30 - least(t.sell_through, {D(30)})) / {D(30)} * 35", sev(22, 14, 7), f"{sev(92, 84, 72)} * {D(0.08)}"),
        whole(f"t.revenue * (1 - t.sell_through / {D(100)}) * {D(0.68)}"), f"-round({sev(45, 30, 18)} * {D(0.55)}, 1)", md_cash, sev(92, 84, 72),
        "SELECT * FROM markdown WHERE rank <= 10", st=fixed("t.sell_through", 0),
        cover=fixed(f"greatest({D(1)}, round({D(100)} / greatest(t.sell_through, {D(0.5)}) * 4, 1))", 1), grade=sev("'Clearance'", "'Deep'", "'Tactical'"), depth="t.recommended_depth"),
    "Reorder": kind(
        "Reorder", 2, "t.rank", "t.sku", "coalesce(t.category, 'General')", urg("'Critical'", "'High'", "'Medium'"),
        points(99, f"least({D(22)}, t.revenue / total_rev * 2200)", f"greatest({D(0)}, (4 - least({ro_cover}, {D(4)})) / {D(4)} * 38)", urg(26, 15, 5), f"{urg(93, 86, 74)} * {D(0.08)}"),
        whole(f"t.revenue / greatest({ro_cover}, {D(0.5)}) * 8 * {D(0.62)}"), "round(avg_margin, 1)", "0", urg(93, 86, 74),
        "SELECT * FROM reorder WHERE rank <= 8", st=fixed(ro_st, 0), cover=fixed(ro_cover, 1), grade=urg("'days'", "'1–2 weeks'", "'3–4 weeks'")),
    "Intake Reduction": kind(
        "Intake Reduction", 3, "-t.revenue", LEVEL, "t.category", crit("'High'", "'Medium'"),
        points(88, f"least({D(18)}, t.revenue / total_rev * 1800)", f"(28 - least(t.avg_sell_through, {D(28)})) / {D(28)} * 28", f"{crit(79, 68)} * {D(0.25)}"),
        "0", f"round((case when coalesce(t.avg_margin_pct, 0) = 0 then avg_margin else t.avg_margin_pct end) * {D(0.08)}, 1)", whole(f"{saving} * {D(0.18)}"), crit(79, 68),
        "SELECT * FROM cats WHERE health IN ('AT RISK', 'CRITICAL') AND avg_sell_through <= 28", st=fixed("t.avg_sell_through", 0),
        cover=f"greatest(12, {whole(f'{D(100)} / greatest(t.avg_sell_through, {D(0.5)}) * 4')})", grade="t.health", amount=pounds(whole("revenue * 0.22"))),
    "PO Cancellation": kind(
        "PO Cancellation", 4, "-t.revenue", LEVEL, "t.category", "'High'",
        points(84, f"least({D(16)}, t.revenue / total_rev * 1600)", f"(18 - least((case when coalesce(t.avg_sell_through, 0) = 0 then {D(10)} else t.avg_sell_through end), {D(18)})) / {D(18)} * 28", D(18.25)),
        "0", "0", whole("t.revenue * 0.14"), "73", "SELECT * FROM cats WHERE health = 'CRITICAL' AND (avg_sell_through IS NULL OR avg_sell_through < 18)",
        st=fixed("coalesce(t.avg_sell_through, 0)", 0), grade="t.health"),
    "Stock Transfer": kind(
        "Stock Transfer", 5, "1", "'Cross-Category'", "t.src || ' → ' || t.dst", "'Medium'",
        points(74, f"least({D(14)}, {moved} / total_rev * 1400)", f"{D(66)} * {D(0.42)}"), whole(f"{moved} * {D(0.55)}"), f"round(avg_margin * {D(0.04)}, 1)", "0", "66",
        """SELECT s.dataset_id, s.category AS src, s.revenue AS src_rev, s.avg_sell_through AS src_st, f.category AS dst, f.revenue AS dst_rev, f.avg_sell_through AS dst_st
          FROM (SELECT * FROM cats WHERE health IN ('AT RISK', 'CRITICAL') AND avg_sell_through <> 0 AND avg_sell_through < 28 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) = 1) s
          JOIN (SELECT * FROM cats WHERE health IN ('STRONG', 'HEALTHY') AND avg_sell_through > 55 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) = 1) f
          ON f.dataset_id = s.dataset_id""",
        st=fixed("t.src_st", 0), cover=fixed("t.dst_st", 0), source="t.src", target="t.dst"),
    "Supplier Review": kind(
        "Supplier Review", 6, "-t.revenue", LEVEL, "t.category", "'Medium'",
        points(72, f"least({D(12)}, t.revenue / total_rev * 1200)", f"{gap} * {D(0.9)}", f"{D(63)} * {D(0.22)}"), whole(f"{gain} * {D(0.35)}"), f"round({gap}, 1)", "0", "63",
        "SELECT * FROM cats WHERE avg_margin_pct <= 38 AND avg_sell_through <= 42", st=fixed("t.avg_sell_through", 0), margin=fixed("t.avg_margin_pct", 0),
        amount=pounds(f"round_even(revenue * greatest({D(0)}, 48 - avg_margin_pct) / {D(100)}, 0)")),
}
CTES["actions"] = "\nUNION ALL ".join(KINDS.values())
CTES["ranked_actions"] = """
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY priority_score DESC, type_order, seq, category, sku) AS rank FROM actions"""


def one_kind(key, name, fn, table):
    @register(key, f"SELECT * FROM ({KINDS[name]})")
    def _(spark, d):
        return fn(book(spark, d).prepare(table, "kpis"))


one_kind("actions_markdown", "Markdown", lambda b: actions.actions_markdown(b.markdown_risk, b.kpis), "markdown_risk")
one_kind("actions_reorder", "Reorder", lambda b: actions.actions_reorder(b.reorder_alerts, b.kpis), "reorder_alerts")
one_kind("actions_intake", "Intake Reduction", lambda b: actions.actions_intake(b.categories, b.kpis), "categories")
one_kind("actions_po_cancel", "PO Cancellation", lambda b: actions.actions_po_cancel(b.categories, b.kpis), "categories")
one_kind("actions_transfer", "Stock Transfer", lambda b: actions.actions_transfer(b.categories, b.kpis), "categories")
one_kind("actions_supplier", "Supplier Review", lambda b: actions.actions_supplier(b.categories, b.kpis), "categories")


def ranked(spark, d) -> DataFrame:
    b = book(spark, d).prepare(*STORED)
    return actions.action_centre(b.markdown_risk, b.reorder_alerts, b.categories, b.kpis)


@register("action_centre", "SELECT * FROM ranked_actions")
def _(spark, d):
    return ranked(spark, d)


@register("action_rank", "SELECT dataset_id, rank, type, sku, category, priority_score FROM ranked_actions")
def _(spark, d):
    return ranked(spark, d).select("dataset_id", "rank", "type", "sku", "category", "priority_score")


@register("action_summary", """
SELECT dataset_id, count(*) AS total_actions, cast(count_if(priority_label = 'Critical') as bigint) AS critical_count, cast(count_if(priority_label = 'High') as bigint) AS high_count,
  cast(count_if(priority_label = 'Medium') as bigint) AS medium_count, cast(sum(cast(revenue_impact as bigint)) as bigint) AS total_opportunity,
  cast(sum(cast(cash_recovery as bigint)) as bigint) AS total_cash_recovery, cast(round_even(cast(sum(confidence) as double) / count(*), 0) as bigint) AS avg_confidence
FROM actions GROUP BY dataset_id""")
def _(spark, d):
    b = book(spark, d).prepare(*STORED)
    return actions.action_summary(actions.all_actions(b.markdown_risk, b.reorder_alerts, b.categories, b.kpis))


# ---- category drill-down -------------------------------------------------------------

CAT_SCORE = """case when coalesce(avg_sell_through, 0) = 0 and coalesce(avg_margin_pct, 0) = 0 then 0 else cast(round_even(greatest(0, least(100,
  least(coalesce(avg_sell_through, 0), 100) / cast(100 as double) * 55 + least(coalesce(avg_margin_pct, 0), 60) / cast(60 as double) * 45)), 0) as int) end"""
CTES["cat_top"] = """
  SELECT * FROM (SELECT dataset_id, lower(category) AS cat_key, row_number() OVER (PARTITION BY dataset_id, lower(category) ORDER BY best.revenue DESC, best.rank) AS rank,
    sku, coalesce(name, sku) AS name, revenue, units, sell_through, margin_pct, stock FROM best) WHERE rank <= 5"""
CTES["cat_slow_all"] = """
  SELECT m.dataset_id, lower(m.category) AS cat_key, m.sku, coalesce(m.name, b.name, m.sku) AS name, m.revenue, coalesce(b.units, 0) AS units, m.sell_through, b.margin_pct, b.stock, m.rank AS seq
  FROM markdown m LEFT JOIN best b ON b.dataset_id = m.dataset_id AND b.sku = m.sku
  WHERE NOT EXISTS (SELECT 1 FROM cat_top t WHERE t.dataset_id = m.dataset_id AND t.cat_key = lower(m.category) AND t.sku = m.sku)"""
CTES["cat_slow"] = """
  SELECT * EXCLUDE (seq) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cat_key ORDER BY sell_through ASC NULLS LAST, seq) AS rank FROM (
    SELECT * FROM cat_slow_all UNION ALL
    SELECT b.dataset_id, lower(b.category), b.sku, coalesce(b.name, b.sku), b.revenue, b.units, b.sell_through, b.margin_pct, b.stock, b.rank FROM best b
    WHERE b.sell_through IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat_top t WHERE t.dataset_id = b.dataset_id AND t.cat_key = lower(b.category) AND t.sku = b.sku)
      AND NOT EXISTS (SELECT 1 FROM cat_slow_all s WHERE s.dataset_id = b.dataset_id AND s.cat_key = lower(b.category)))) WHERE rank <= 5"""
CAT_RULES = [
    ("avg_sell_through < 30", "Markdown", text("Clear ageing {c} stock — {st}% sell-through signals weak demand; a 20–30% markdown releases working capital.", c="category", st=fixed("avg_sell_through", 0))),
    ("avg_sell_through >= 45", "Reorder", text("Lean into {c} — {st}% sell-through is outpacing supply; increase buying depth before stockouts.", c="category", st=fixed("avg_sell_through", 0))),
    ("avg_margin_pct < 40", "Margin", text("Protect {c} margin — at {m}% it sits below the 40% benchmark; review cost prices and discount depth.", c="category", m=fixed("avg_margin_pct", 0))),
    ("weak_st <> 0 AND weak_st < 25", "Review", text("{n} is the weakest line at {st}% — consider markdown or delisting.", n="weak_name", st=fixed("weak_st", 0))),
]
RULE_LIST = "[x for x in [" + ", ".join(f"case when {c} then {{'type': '{k}', 'text': {t}}} end" for c, k, t in CAT_RULES) + "] if x IS NOT NULL]"
CALM = text("{c} is trading in line with the range — monitor weekly and hold current strategy.", c="category")
CTES["cat_rules"] = f"""
  SELECT dataset_id, category, case when len(rules) = 0 then [{{'type': 'Monitor', 'text': {CALM}}}] else rules end AS rules
  FROM (SELECT c.dataset_id, category, {RULE_LIST} AS rules FROM cats c
    LEFT JOIN (SELECT dataset_id AS wd, cat_key AS wk, name AS weak_name, sell_through AS weak_st FROM cat_slow WHERE rank = 1) w ON w.wd = c.dataset_id AND w.wk = lower(c.category))"""


@register("category_cards", f"""
SELECT dataset_id, category, revenue, units, sku_count, avg_sell_through AS sell_through, avg_margin_pct AS margin, {CAT_SCORE} AS health, health AS health_label FROM cats c WHERE revenue > 0""")
def _(spark, d):
    return category.category_cards(book(spark, d).categories)


@register("category_top_sellers", "SELECT * FROM cat_top")
def _(spark, d):
    return category.category_top_sellers(book(spark, d).best_sellers)


@register("category_slow_movers", "SELECT * FROM cat_slow")
def _(spark, d):
    b = book(spark, d).prepare("best_sellers", "markdown_risk", "categories")
    return category.category_slow_movers(b.best_sellers, b.markdown_risk)


@register("category_actions", """
SELECT dataset_id, category, pos, r.type AS type, r.text AS text FROM (SELECT dataset_id, category, unnest(range(1, len(rules) + 1)) AS pos, unnest(rules) AS r FROM cat_rules)""")
def _(spark, d):
    b = book(spark, d).prepare("best_sellers", "markdown_risk", "categories")
    return category.category_actions(b.categories, category.category_slow_movers(b.best_sellers, b.markdown_risk))


@register("category_detail", f"""
SELECT c.dataset_id, c.category, revenue, units, sku_count, avg_sell_through AS sell_through, avg_margin_pct AS margin, {CAT_SCORE} AS health, c.health AS health_label,
  coalesce(t.skus, '') AS top_sellers, coalesce(s.skus, '') AS slow_movers, list_aggregate([x.type for x in rules], 'string_agg', ',') AS actions
FROM cats c JOIN cat_rules r ON r.dataset_id = c.dataset_id AND r.category = c.category
LEFT JOIN (SELECT dataset_id, cat_key, string_agg(sku, ',' ORDER BY rank) AS skus FROM cat_top GROUP BY 1, 2) t ON t.dataset_id = c.dataset_id AND t.cat_key = lower(c.category)
LEFT JOIN (SELECT dataset_id, cat_key, string_agg(sku, ',' ORDER BY rank) AS skus FROM cat_slow GROUP BY 1, 2) s ON s.dataset_id = c.dataset_id AND s.cat_key = lower(c.category)""")
def _(spark, d):
    b = book(spark, d).prepare("best_sellers", "markdown_risk", "categories")
    return category.category_detail(b.categories, b.best_sellers, b.markdown_risk)


# ---- reports and exports -------------------------------------------------------------

given = lambda c, template, other: f"coalesce({text(template, x=c)}, '{other}')"
choose = lambda c, yes, no: f"case when {c} then '{yes}' else '{no}' end"
REPORT_SQL = {
    "verdict": "case when avg_sell_through >= 45 and avg_margin_pct >= 45 then 'positive' when avg_sell_through < 25 then 'under pressure' else 'mixed' end",
    "rev": pounds("total_revenue"), "st": fixed("avg_sell_through", 0), "skus": "sku_count", "units": grouped("total_units"), "mg": fixed("avg_margin_pct", 1),
    "cover": fixed("avg_cover_weeks", 1), "reorders": "reorder_count", "markdowns": "markdown_risk_count", "profit": pounds("gross_profit"),
    "asp": fixed("total_revenue / greatest(total_units, 1)", 2), "top": "coalesce(top_cat, 'the top category')",
    "risk_stock": given("weak_cat", "{x} presents the most significant stock risk.", "stock cover requires monitoring."),
    "focus": choose("avg_sell_through >= 40", "protecting full-price sell-through", "accelerating clearance and improving rate of sale"),
    "expectation": choose("avg_sell_through >= 45", "ahead of expectations", "below target"),
    "performer": given("best_sku", "Top performer {x} is contributing significantly to overall revenue delivery. ", ""),
    "quality": choose("avg_sell_through >= 45", "appears healthy with strong full-price activity", "is under pressure with elevated markdown dependency"),
    "margin_note": choose("avg_margin_pct >= 45", "Margin is above the 45% threshold, indicating disciplined full-price selling.",
                          "Margin is below the 45% target — intake pricing or markdown activity is compressing returns."),
    "cover_note": choose("avg_cover_weeks between 4 and 8", "is within the target 4–8 week range.", "is outside target, requiring rebalancing action."),
    "markdown_note": f"case when markdown_risk_count > 0 then {text('Markdown risk across {n} SKUs represents potential working capital trapped in slow-moving lines.', n='markdown_risk_count')} else 'Markdown exposure is currently minimal.' end",
    "signals": choose("strong_cat is not null", "strong health signals", "healthy sell-through"),
    "concern": given("weak_cat", "{x} is the primary area of concern", "At-risk categories require immediate attention"),
    "candidate": given("md1_sku", "{x} is the highest-priority markdown candidate.", "Markdown candidates span multiple categories."),
    "critical": given("critical_sku", "{x} is the most critical.", "Critical SKUs should be fast-tracked for reorder."),
    "risk_or_some": "coalesce(weak_cat, 'at-risk categories')", "risk_or_several": "coalesce(weak_cat, 'several categories')",
    "risk_or_under": "coalesce(weak_cat, 'Underperforming categories')",
    "mix": choose("avg_sell_through >= 40", "favouring stronger performers", "showing signs of strain across multiple departments"),
    "concentration": given("weak_cat", "the {x} category", "slow-moving categories"),
}


@register("trade_report", " UNION ALL ".join(f"SELECT dataset_id, '{k}' AS section, {text(t, **REPORT_SQL)} AS text FROM firsts" for k, t in reports.REPORT.items()))
def _(spark, d):
    return reports.trade_report(book(spark, d).heads)


CONTEXT = ["SELECT dataset_id, 'kpis' AS section, cast(1 as double) AS seq, NULL AS sku, NULL AS category, total_revenue AS revenue, cast(sku_count as double) AS skus FROM kpis"] + [
    f"SELECT dataset_id, '{k}', cast(rank as double), sku, {c}, {r}, NULL FROM {t} WHERE rank <= 8 AND dataset_id NOT IN (SELECT pd FROM private_sets)"
    for k, t, c, r in (("top_reorders", "reorder", "category", "NULL"), ("top_markdown_risk", "markdown", "category", "NULL"), ("best_sellers", "best", "NULL", "revenue"))] + [
    "SELECT dataset_id, 'categories', -revenue, NULL, case when pd IS NULL then category end, revenue, cast(sku_count as double) FROM cats LEFT JOIN private_sets ON pd = dataset_id"]


@register("assistant_context", " UNION ALL ".join(CONTEXT))
def _(spark, d):
    """Fields read back from every JSON line."""
    b = book(spark, d).prepare(*STORED)
    lines = reports.context_lines(b.kpis, b.best_sellers, b.reorder_alerts, b.markdown_risk, b.categories, b.private_datasets(tt.companies(spark, d)))
    field = lambda name, kind="string": F.get_json_object("line", f"$.{name}").cast(kind)
    section = F.col("section")
    return lines.select(
        "dataset_id", "section", "seq", field("sku").alias("sku"), F.when(section != "best_sellers", field("category")).alias("category"),
        F.when(section == "kpis", field("total_revenue", "double")).when(section.isin("best_sellers", "categories"), field("revenue", "double")).alias("revenue"), field("sku_count", "double").alias("skus"))


LINE_FIELDS = {"rev": pounds("total_revenue"), "units": grouped("total_units"), "profit": pounds("gross_profit"), "mg": fixed("avg_margin_pct", 1), "st": fixed("avg_sell_through", 1),
               "cover": fixed("avg_cover_weeks", 1), "skus": "sku_count", "trend": "trend", "reorders": "reorder_count", "critical": "critical_oos_count", "markdowns": "markdown_risk_count"}
CTES["trends"] = """SELECT dataset_id AS td, case when n >= 2 and l > f then 'improving' when n >= 2 and l < f then 'declining' else 'stable' end AS trend
  FROM (SELECT dataset_id, count(*) AS n, arg_min(revenue, week) AS f, arg_max(revenue, week) AS l
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY week DESC) AS r FROM weekly) WHERE r <= 6 GROUP BY 1)"""
LINES = [f"SELECT dataset_id, 'summary' AS section, {i + 1} AS pos, {text(t, **LINE_FIELDS)} AS line FROM kpis JOIN trends ON td = dataset_id" for i, t in enumerate(reports.REPORT_LINES)] + [
    f"""SELECT dataset_id, 'categories', pos, {text(reports.CATEGORY_LINE, category='category', rev=pounds('revenue'), st='avg_sell_through', mg='avg_margin_pct', health='health')}
      FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) AS pos FROM cats) WHERE pos <= 8 AND dataset_id NOT IN (SELECT pd FROM private_sets)""",
    f"SELECT dataset_id, 'reorders', rank, {text(reports.REORDER_LINE, sku='sku', category='category', urgency='urgency', cover='cover_weeks', st='sell_through')} FROM reorder WHERE rank <= 5 AND dataset_id NOT IN (SELECT pd FROM private_sets)",
    f"SELECT dataset_id, 'markdowns', rank, {text(reports.MARKDOWN_LINE, sku='sku', category='category', st='sell_through', severity='severity')} FROM markdown WHERE rank <= 5 AND dataset_id NOT IN (SELECT pd FROM private_sets)",
    f"SELECT dataset_id, 'sellers', rank, {text(reports.SELLER_LINE, sku='sku', rev=pounds('revenue'), st='sell_through')} FROM best WHERE rank <= 5 AND dataset_id NOT IN (SELECT pd FROM private_sets)",
]


@register("report_context", " UNION ALL ".join(LINES))
def _(spark, d):
    b = book(spark, d).prepare(*STORED, "weekly")
    return reports.report_context(b.kpis, b.best_sellers, b.reorder_alerts, b.markdown_risk, b.categories, role_view.trend_direction(b.weekly), b.private_datasets(tt.companies(spark, d)))


CENTRE_MEMORY = """(SELECT dataset_id AS sd, coalesce(string_agg(text, '; ' ORDER BY text) FILTER (outcome = 'improved'), '') AS improved,
  coalesce(string_agg(text, '; ' ORDER BY text) FILTER (outcome = 'declined'), '') AS declined FROM memory GROUP BY 1)"""


def memory_sql(c, label):
    diff = f"(cast({c} as double) - prev_{c})"
    shown = pounds(diff) if c == "revenue" else fixed(diff, 1) + (" || ' pts'" if c == "health" else " || '%'")
    return f"""SELECT user_id, dataset_id, seq, '{c}' AS metric, case when {diff} >= 0 then 'improved' else 'declined' end AS outcome, round({diff}, 2) AS diff,
      '{label} ' || case when {diff} >= 0 then '+' else '' end || {shown} AS text FROM moves WHERE prev_revenue IS NOT NULL AND abs({diff}) >= 0.5"""


CTES["memory"] = " UNION ALL ".join(memory_sql(c, l) for c, l in
                                    {"revenue": "Revenue", "margin": "Margin", "sell_through": "Sell-through", "health": "Business Health"}.items())


@register("command_centre", f"""
SELECT f.dataset_id, health AS health_score, case when health >= 80 then 'Healthy' when health >= 60 then 'Watch' else 'At Risk' end AS health_label, total_revenue, avg_margin_pct,
  avg_sell_through, {OPPORTUNITIES[0]} AS top_opportunity, {RISKS[0]} AS top_risk, cast(round_even(abs(down), 0) as bigint) AS revenue_at_stake,
  cast(round_even(total_revenue * 0.04, 0) as bigint) AS margin_protect, cast(round_even(up, 0) as bigint) AS total_upside, actions,
  coalesce(improved, '') AS improved, coalesce(declined, '') AS declined, round(rd, 4) AS rev_delta
FROM firsts f JOIN (SELECT dataset_id AS ad, sum(greatest(revenue_impact, 0)) AS up, sum(least(revenue_impact, 0)) AS down,
    string_agg(type || ' — ' || sku, '; ' ORDER BY rank) FILTER (rank <= 5) AS actions FROM role_actions GROUP BY 1) ON ad = f.dataset_id
LEFT JOIN {CENTRE_MEMORY} ON sd = f.dataset_id
LEFT JOIN (SELECT dataset_id AS md, (revenue - prev_revenue) / nullif(prev_revenue, 0) * 100 AS rd FROM moves) ON md = f.dataset_id""")
def _(spark, d):
    b = book(spark, d).prepare(*STORED, "weekly")
    c = reports.command_centre(b.heads, b.role_actions, timeline.business_memory(b.timeline), timeline.review_moves(b.timeline))
    joined = lambda name: F.coalesce(F.array_join(name, "; "), F.lit("")).alias(name)
    return c.select("dataset_id", "health_score", "health_label", "total_revenue", "avg_margin_pct", "avg_sell_through", "top_opportunity", "top_risk",
                    "revenue_at_stake", "margin_protect", "total_upside", F.array_join(F.transform("actions", lambda a: a["action"]), "; ").alias("actions"),
                    joined("improved"), joined("declined"), F.round("rev_delta", 4).alias("rev_delta"))


SUMMARY = [("Total Revenue", pounds("total_revenue")), ("Total Units", grouped("total_units")), ("Gross Profit", pounds("gross_profit")),
           ("Average Sell-Through", fixed("avg_sell_through", 1) + " || '%'"), ("Average Margin", fixed("avg_margin_pct", 1) + " || '%'"),
           ("Blended Gross Margin", fixed("gross_margin_pct", 1) + " || '%'"), ("Average Stock Cover", fixed("avg_cover_weeks", 1) + " || ' weeks'"),
           ("Reorder Alerts", "cast(reorder_count as varchar)"), ("Markdown Risk SKUs", "cast(markdown_risk_count as varchar)"),
           ("Critical Stockouts", "cast(critical_oos_count as varchar)")]


@register("export_summary", " UNION ALL ".join(f"SELECT dataset_id, {i + 1} AS pos, '{m}' AS metric, {v} AS value FROM kpis" for i, (m, v) in enumerate(SUMMARY)))
def _(spark, d):
    return publish.export_summary(book(spark, d).kpis)


def export(key, title, table, source, order=True):
    cols = ", ".join(f'{c} AS "{label}"' for c, label in publish.EXPORT_COLUMNS[title].items())

    @register(key, f"SELECT dataset_id, {'rank, ' if order else ''}{cols} FROM {table}")
    def _(spark, d):
        return publish.export_table(source(book(spark, d)), title)


export("export_categories", "Categories", "cats", lambda b: b.categories, order=False)
export("export_best_sellers", "Best Sellers", "best", lambda b: b.best_sellers)
export("export_reorder_alerts", "Reorder Alerts", "reorder", lambda b: b.reorder_alerts)
export("export_markdown_risk", "Markdown Risk", "markdown", lambda b: b.markdown_risk)


SHEETS_BACK = {"Categories": ("cats", "category"), "Best Sellers": ("best", "sku"), "Reorder Alerts": ("reorder", "sku"), "Markdown Risk": ("markdown", "sku")}


@register("export_tables", " UNION ALL ".join(
    ["SELECT dataset_id, 'Summary' AS sheet, metric AS key, value FROM (" + " UNION ALL ".join(f"SELECT dataset_id, '{m}' AS metric, {v} AS value FROM kpis" for m, v in SUMMARY) + ")"]
    + [f"SELECT dataset_id, '{k}', cast({c} as varchar), NULL FROM {t}" for k, (t, c) in SHEETS_BACK.items()]))
def _(spark, d):
    """Write the five export tables, then read their rows back."""
    path = scratch(spark, "export")
    publish.export_tables(book(spark, d).prepare("rollup", *STORED).tables(), path)
    read = lambda sheet: spark.read.csv(f"{path}/{sheet}", header=True)
    back = [read("Summary").select("dataset_id", F.lit("Summary").alias("sheet"), F.col("metric").alias("key"), "value")]
    for sheet, (_, column) in SHEETS_BACK.items():
        label = publish.EXPORT_COLUMNS[sheet][column]
        back.append(read(sheet).select("dataset_id", F.lit(sheet).alias("sheet"), F.col(f"`{label}`").alias("key"), F.lit(None).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, back)


PUBLISHED = {"sku_rollup": ("sku_rollup", "sku", "revenue"), "kpis": ("kpis", "NULL", "total_revenue"), "best_sellers": ("best", "sku", "revenue"), "reorder_alerts": ("reorder", "sku", "cover_weeks"),
             "markdown_risk": ("markdown", "sku", "sell_through"), "category_scorecard": ("cats", "category", "revenue"), "weekly_trend": ("weekly", "week", "revenue"),
             "channel_split": ("(SELECT dataset_id, channel, round(sum(revenue), 2) AS revenue FROM trading_lines GROUP BY 1, 2)", "channel", "revenue")}


PUBLISHED_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS table_name, dataset_id, cast({c} as varchar) AS key, round(cast({v} as double), 4) AS amount FROM {t}" for k, (t, c, v) in PUBLISHED.items())


@register("publish_analysis", PUBLISHED_SQL)
def _(spark, d):
    """Publish all tables, then read their rows back."""
    path = scratch(spark, "published")
    publish.publish_analysis(book(spark, d).prepare("rollup", *STORED, "periods").tables(), path)
    return published_rows({k: spark.read.parquet(f"{path}/{k}") for k in PUBLISHED})


@register("publish_sheets", PUBLISHED_SQL)
def _(spark, d):
    """The same tables after publishing in two steps: the sheets of odd lines with a third of all
    others, and then all others, which replaces that form of their sheets."""
    store = AnalysisStore(spark, scratch(spark, "store"))
    number = F.pmod(F.col("row_id.l_orderkey"), F.lit(4))
    with shuffles_freed(spark):
        lines = staged(tt.trading_lines(spark, d).withColumn("sheet", F.concat(F.lit("sheet "), number.cast("string"))), "sheet-lines")
    odd = number % 2 == 1
    store.publish(lines.where(odd | (F.pmod(F.col("row_id.l_suppkey"), F.lit(3)) == 0)))
    store.publish(lines.where(~odd))
    return published_rows(store.tables())


def published_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Key and amount of every row of the published tables."""
    key = lambda c: F.lit(None).cast("string") if c == "NULL" else F.col(c).cast("string")
    back = [tables[k].select(F.lit(k).alias("table_name"), "dataset_id", key(c).alias("key"), F.round(F.col(v).cast("double"), 4).alias("amount")) for k, (_, c, v) in PUBLISHED.items()]
    return reduce(DataFrame.unionByName, back)
