"""SQL building blocks: the fixtures and the analysis tables restated for DuckDB."""

from __future__ import annotations

from tradeloom.plans.registry import CTES, mean, whole

AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"

CTES["raw_lines"] = """
  SELECT l.*, o_custkey, c_mktsegment, p_name, p_brand, p_size, p_retailprice, s_name, r_name,
    cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) AS b
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["priced_lines"] = """
  SELECT *, 20 + (b * 7) % 45 + l_suppkey % 10 AS mg,
    cast((20 + (b * 7) % 45 + l_suppkey % 10) / 100.0 as decimal(4,2)) AS share,
    cast(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))) as decimal(18,4)) AS rev
  FROM raw_lines"""

CTES["trading_lines"] = """
  SELECT c_mktsegment || ':' || cast(year(l_shipdate) as varchar) AS dataset_id, c_mktsegment AS user_id,
    {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'e': l_extendedprice} AS row_id,
    cast(l_partkey as varchar) AS sku, cast(l_quantity as decimal(18,2)) AS units, rev AS revenue,
    cast((l_orderkey * 7 + l_partkey * 3) % 60 as double) AS stock,
    cast(cast(p_retailprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - share) as decimal(18,4)) AS cost,
    cast(mg as double) AS margin_pct, cast(rev * share as decimal(18,6)) AS margin_value,
    cast(p_retailprice as decimal(18,2)) AS retail,
    least(cast(100 as double), cast((l_orderkey * 13 + l_partkey * 5) % 96 * b as double) / cast(18 as double)) AS sell_through,
    cast((l_orderkey + l_partkey * 11) % 200 as double) / cast(10 as double) AS cover_weeks,
    cast(p_size * 10 as double) AS buy_qty,
    case when l_discount = 0 then rev else cast(0 as decimal(18,4)) end AS full_price_sales,
    p_brand AS category, r_name AS channel, cast(cast(date_trunc('week', l_shipdate) as date) as varchar) AS week,
    p_name AS name, s_name AS brand
  FROM priced_lines"""

CTES["sku_rollup"] = f"""
  SELECT dataset_id, sku, sum(units) AS units, sum(revenue) AS revenue, sum(cost) AS cost,
    sum(full_price_sales) AS full_price_sales, sum(margin_value) AS margin_value, {mean('margin_pct')} AS margin_pct,
    arg_max(stock, row_id) AS stock, arg_max(sell_through, row_id) AS sell_through, arg_max(cover_weeks, row_id) AS cover_weeks,
    arg_min(category, row_id) AS category, arg_min(channel, row_id) AS channel, arg_min(name, row_id) AS name,
    arg_min(brand, row_id) AS brand, arg_min(buy_qty, row_id) AS buy_qty
  FROM trading_lines GROUP BY dataset_id, sku"""

IS_REORDER = "(stock = 0 OR cover_weeks <= 4 OR (sell_through >= 70 AND stock < 20))"
URGENCY = "(case when stock = 0 or cover_weeks <= 1 then 'CRITICAL' when cover_weeks <= 2 then 'URGENT' else 'REORDER' end)"
IS_MARKDOWN = "(sell_through < 30 AND stock > 0)"
SEVERITY = "(case when sell_through < 15 then 'CLEARANCE' when sell_through < 22 then 'DEEP' else 'TACTICAL' end)"
GM = "(case when sum(revenue) <> 0 then cast(sum(margin_value) as double) / cast(sum(revenue) as double) * 100 else 0 end)"

CTES["kpis"] = f"""
  SELECT dataset_id, count(*) AS sku_count, cast(round(sum(revenue), 2) as double) AS total_revenue,
    {whole('cast(sum(units) as double)')} AS total_units, round(cast(sum(margin_value) as double), 2) AS gross_profit,
    round({mean('sell_through')}, 1) AS avg_sell_through, round({mean('margin_pct')}, 1) AS avg_margin_pct,
    round({GM}, 1) AS gross_margin_pct, true AS margin_available, 'explicit' AS margin_source,
    round({mean('cover_weeks')}, 1) AS avg_cover_weeks, cast(count_if({IS_REORDER}) as bigint) AS reorder_count,
    cast(count_if({IS_MARKDOWN}) as bigint) AS markdown_risk_count, cast(count_if({IS_REORDER} AND {URGENCY} = 'CRITICAL') as bigint) AS critical_oos_count
  FROM sku_rollup GROUP BY dataset_id"""

CTES["best"] = f"""
  SELECT * FROM (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY r.revenue DESC, sku) AS rank, sku,
    cast(round(r.revenue, 2) as double) AS revenue, {whole('cast(units as double)')} AS units, name, category,
    round(sell_through, 1) AS sell_through, round(margin_pct, 1) AS margin_pct, round_even(stock, 0) AS stock
    FROM sku_rollup r) WHERE rank <= 20"""

CTES["reorder"] = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY
      case urgency when 'CRITICAL' then 1 when 'URGENT' then 2 else 3 end, revenue DESC, sku) AS rank
    FROM (SELECT dataset_id, sku, {URGENCY} AS urgency, cast(round(revenue, 2) as double) AS revenue, name, category,
      round_even(stock, 0) AS stock, round(cover_weeks, 1) AS cover_weeks, round(sell_through, 1) AS sell_through
      FROM sku_rollup WHERE {IS_REORDER})) WHERE rank <= 50"""

CTES["markdown"] = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY
      case severity when 'CLEARANCE' then 1 when 'DEEP' then 2 else 3 end, revenue DESC, sku) AS rank
    FROM (SELECT dataset_id, sku, {SEVERITY} AS severity, round(sell_through, 1) AS sell_through,
      case {SEVERITY} when 'CLEARANCE' then '40–50%' when 'DEEP' then '25–35%' else '15–20%' end AS recommended_depth,
      cast(round(revenue, 2) as double) AS revenue, name, category FROM sku_rollup WHERE {IS_MARKDOWN})) WHERE rank <= 50"""

CTES["cats"] = f"""
  SELECT dataset_id, category, revenue, units, sku_count, round(st, 1) AS avg_sell_through, avg_margin_pct,
    case when st is null or st = 0 then 'UNKNOWN' when st >= 40 then 'STRONG' when st >= 25 then 'HEALTHY'
      when st >= 15 then 'AT RISK' else 'CRITICAL' end AS health
  FROM (SELECT dataset_id, category, cast(round(sum(revenue), 2) as double) AS revenue, {whole('cast(sum(units) as double)')} AS units,
    count(*) AS sku_count, {mean('sell_through')} AS st, round({mean('margin_pct')}, 1) AS avg_margin_pct
    FROM sku_rollup GROUP BY dataset_id, category)"""

CTES["weekly"] = """
  SELECT dataset_id, week, cast(round(sum(revenue), 2) as double) AS revenue FROM trading_lines GROUP BY dataset_id, week"""

CTES["health_points"] = """
  SELECT *, greatest(0, least(30, cast(round_even(least(cast(1 as double), st / cast(85 as double)) * 18 + least(cast(1 as double), mg / cast(60 as double)) * 12, 0) as int))) AS p_revenue,
    case when st >= 70 then 20 when st >= 55 then 16 when st >= 40 then 12 when st >= 25 then 7 else 3 end AS p_sell_through,
    case when mg >= 60 then 20 when mg >= 50 then 16 when mg >= 40 then 12 when mg >= 30 then 7 else 3 end AS p_margin,
    case when cover between 4 and 8 then 18 when (cover >= 2 and cover < 4) or (cover > 8 and cover <= 12) then 13
      when (cover >= 1 and cover < 2) or (cover > 12 and cover <= 16) then 7 else 3 end AS p_stock,
    cast(greatest(0, 10 - least(5, critical_oos_count * 2) - least(3, reorder_count // 5) - least(2, markdown_risk_count // 5)) as int) AS p_risk
  FROM (SELECT *, avg_sell_through AS st, case when gross_margin_pct = 0 then avg_margin_pct else gross_margin_pct end AS mg,
    avg_cover_weeks AS cover FROM kpis)"""

CTES["scored"] = """
  SELECT *, cast(greatest(0, least(100, p_revenue + p_sell_through + p_margin + p_stock + p_risk)) as int) AS health FROM health_points"""

CTES["firsts"] = """
  SELECT k.*, b1.sku AS best_sku, b1.revenue AS best_rev, coalesce(bs.stock_units, 0) AS stock_units, coalesce(bs.missing, 0) AS missing_data_count,
    r1.sku AS ro1_sku, r1.urgency AS ro1_urgency, r1.revenue AS ro1_rev, r2.sku AS ro2_sku, r2.revenue AS ro2_rev, rs.critical_sku,
    coalesce(rs.open_po_count, 0) AS open_po_count, coalesce(cast(round(rs.open_po_revenue * cast(0.15 as decimal(4,2)), 2) as double), 0) AS open_po_value,
    m1.sku AS md1_sku, m1.severity AS md1_sev, m1.revenue AS md1_rev, m1.sell_through AS md1_st, m1.recommended_depth AS md1_depth,
    m2.sku AS md2_sku, m2.severity AS md2_sev, m2.revenue AS md2_rev, m2.recommended_depth AS md2_depth, coalesce(ms.n, 0) AS markdown_rows,
    t.category AS top_cat, t.revenue AS top_rev, t.avg_sell_through AS top_st,
    w.category AS weak_cat, w.revenue AS weak_rev, w.avg_sell_through AS weak_st, w.health AS weak_health, coalesce(cs.weak_count, 0) AS weak_count,
    g.category AS strong_cat, g.revenue AS strong_rev, g.avg_sell_through AS strong_st
  FROM scored k
  LEFT JOIN best b1 ON b1.dataset_id = k.dataset_id AND b1.rank = 1
  LEFT JOIN (SELECT dataset_id, sum(stock) AS stock_units, cast(count_if(coalesce(stock, 0) = 0 OR coalesce(margin_pct, 0) = 0 OR coalesce(sell_through, 0) = 0) as bigint) AS missing
    FROM best GROUP BY 1) bs ON bs.dataset_id = k.dataset_id
  LEFT JOIN reorder r1 ON r1.dataset_id = k.dataset_id AND r1.rank = 1
  LEFT JOIN reorder r2 ON r2.dataset_id = k.dataset_id AND r2.rank = 2
  LEFT JOIN (SELECT dataset_id, arg_min(sku, rank) FILTER (urgency = 'CRITICAL') AS critical_sku, cast(count_if(urgency <> 'REORDER') as bigint) AS open_po_count,
    sum(cast(revenue as decimal(18,2))) FILTER (urgency <> 'REORDER') AS open_po_revenue FROM reorder GROUP BY 1) rs ON rs.dataset_id = k.dataset_id
  LEFT JOIN markdown m1 ON m1.dataset_id = k.dataset_id AND m1.rank = 1
  LEFT JOIN markdown m2 ON m2.dataset_id = k.dataset_id AND m2.rank = 2
  LEFT JOIN (SELECT dataset_id, count(*) AS n FROM markdown GROUP BY 1) ms ON ms.dataset_id = k.dataset_id
  LEFT JOIN (SELECT * FROM cats QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) = 1) t ON t.dataset_id = k.dataset_id
  LEFT JOIN (SELECT * FROM cats WHERE health IN ('AT RISK', 'CRITICAL') QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) = 1) w ON w.dataset_id = k.dataset_id
  LEFT JOIN (SELECT * FROM cats WHERE health = 'STRONG' QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY revenue DESC, category) = 1) g ON g.dataset_id = k.dataset_id
  LEFT JOIN (SELECT dataset_id, cast(count_if(health IN ('AT RISK', 'CRITICAL')) as bigint) AS weak_count FROM cats GROUP BY 1) cs ON cs.dataset_id = k.dataset_id"""

CTES["datasets"] = """
  SELECT dataset_id, user_id, case user_id when 'AUTOMOBILE' then '0' when 'BUILDING' then '1' when 'FURNITURE' then '2'
      when 'HOUSEHOLD' then '3' when 'MACHINERY' then '4' else '5' end AS company_id,
    ['buy_plan_', 'clearance_', 'supplier_', 'stock_', 'range_', 'weekly_'][y % 6 + 1] || y ||
      ['.csv', '.xlsx', '.ods', '.tsv', '.txt', '.numbers'][y % 6 + 1] AS filename,
    cast(make_date(y, 12, 31) as timestamp) AS created_at, cast(y * 1000 as bigint) AS file_size,
    case when y % 3 = 0 then 'Season ' || y end AS display_name,
    case when y % 2 = 0 then ['season', user_id, 'key'] else ['season', user_id] end AS tags, y % 7 = 0 AS archived, y % 5 = 1 AS trashed
  FROM (SELECT DISTINCT dataset_id, user_id, cast(split_part(dataset_id, ':', 2) as bigint) AS y FROM trading_lines)"""

CTES["pairs"] = """
  SELECT p.user_id, p.dataset_id AS a, q.dataset_id AS b FROM datasets p JOIN datasets q
  ON p.user_id = q.user_id AND year(q.created_at) = year(p.created_at) + 1"""

CTES["cards"] = """
  SELECT d.dataset_id, d.user_id, d.company_id, d.filename, coalesce(d.display_name, d.filename) AS display_name, d.created_at AS upload_date,
    case split_part(d.filename, '.', 2) when 'csv' then 'CSV' when 'xlsx' then 'Excel' when 'ods' then 'Spreadsheet' when 'tsv' then 'TSV'
      when 'txt' then 'Text' else 'Numbers' end AS file_type,
    case when d.filename like 'buy_plan%' then 'Buy Plan' when d.filename like 'clearance%' then 'Markdown Plan'
      when d.filename like 'supplier%' then 'Supplier Report' when d.filename like 'stock%' then 'Stock Report'
      when d.filename like 'range%' then 'Range Plan' else 'Trading Report' end AS dataset_type,
    k.sku_count AS record_count, d.file_size, 'Analysed' AS status, d.tags, d.archived, d.trashed, k.total_revenue AS revenue,
    k.avg_margin_pct AS margin, k.avg_sell_through AS sell_through, cast(round_even(k.total_revenue * 0.5 / 12, 0) as bigint) AS stock_value,
    k.health AS health_score
  FROM datasets d JOIN scored k USING (dataset_id)"""

CTES["points"] = """
  SELECT user_id, dataset_id, display_name AS label, upload_date AS date, revenue, margin, sell_through, health_score AS health,
    record_count AS records, case when sell_through >= 70 then 'Reorder best-sellers — strong sell-through, protect availability'
      when sell_through < 45 then 'Trigger early markdown on slow stock to release cash'
      when margin < 40 then 'Review pricing & markdown depth to protect margin'
      else 'Hold and monitor — trading in line with plan' end AS key_rec,
    row_number() OVER (PARTITION BY user_id ORDER BY upload_date, dataset_id) AS seq
  FROM cards WHERE NOT trashed"""

CTES["moves"] = """
  SELECT *, lag(revenue) OVER w AS prev_revenue, lag(margin) OVER w AS prev_margin, lag(sell_through) OVER w AS prev_sell_through,
    lag(health) OVER w AS prev_health, lead(dataset_id) OVER w IS NULL AS is_latest
  FROM points WINDOW w AS (PARTITION BY user_id ORDER BY date, dataset_id)"""

CTES["companies"] = """
  SELECT cast(n_nationkey as varchar) AS company_id, n_name AS name, 'trial' AS plan,
    nullif(24 * (n_nationkey % 4), 0) AS retention_hours, n_nationkey % 3 = 0 AS private_processing_mode FROM nation"""

CTES["private_sets"] = "SELECT dataset_id AS pd FROM datasets d JOIN companies c ON c.company_id = d.company_id WHERE private_processing_mode"
CTES["profiles"] = f"""
  SELECT cast(c_custkey as varchar) AS user_id, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' AS email,
    c_name AS full_name, ['trial', 'starter', 'growth', 'studio', 'legacy'][c_custkey % 5 + 1] AS plan,
    {AS_OF} + to_days(cast(c_custkey % 40 - 20 as int)) AS trial_ends, cast(c_custkey % 70 as int) AS ai_messages_used,
    TIMESTAMP '2023-12-01' + to_months(cast(c_custkey % 2 as int)) AS ai_messages_reset,
    ['MA', 'AM', 'Merchandiser', 'Director', 'Admin'][c_nationkey % 5 + 1] AS role,
    case when c_custkey % 10 <> 0 then cast(c_nationkey as varchar) end AS company_id, c_custkey % 13 <> 0 AS is_active
  FROM customer"""

CTES["audit_logs"] = """
  SELECT event_id AS log_id, ts AS timestamp, cast(user_id as varchar) AS user_id, cast(user_id % 25 as varchar) AS company_id,
    case event_type when 'error' then 'AUTH_FAILED' when 'click' then 'DATA_EXPORT' when 'view' then 'AI_QUERY'
      when 'signup' then 'USER_LOGIN' when 'purchase' then 'FILE_UPLOAD' end AS action,
    case when event_type = 'error' then case when event_id % 2 = 0 then 'FAILURE' else 'BLOCKED' end else 'SUCCESS' end AS status,
    props AS metadata FROM events"""

CTES["billing"] = """
  SELECT 'evt_' || event_id AS id, case event_type when 'purchase' then 'checkout.session.completed'
      when 'click' then 'customer.subscription.updated' else 'customer.subscription.deleted' end AS type, ts,
    'cus_' || user_id AS customer, ['price_starter', 'price_growth', 'price_studio', 'price_other'][event_id % 4 + 1] AS price_id,
    case when event_id % 3 <> 0 then cast(user_id as varchar) end AS reference_id, 'User.' || user_id || '@Example.com' AS email,
    case when event_id % 7 = 0 then 'canceled' else 'active' end AS status, unnest(case when event_id % 10 = 0 then [1, 2] else [1] end) AS delivery
  FROM events WHERE event_type IN ('purchase', 'click', 'error')"""

CTES["attempts"] = """
  SELECT cast(user_id as varchar) AS account, ts, event_id AS attempt_id, event_type = 'signup' AS success
  FROM events WHERE event_type IN ('error', 'signup')"""
