"""Registered queries: comparison of datasets, development over time, the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeloom.operators import compare, role_view, timeline, workspace
from tradeloom.plans.book import AnalysisBook
from tradeloom.plans.registry import CTES, compact, fixed, pounds, register, signed, text
from tradeloom.sources import publish, testtables as tt
from tradeloom.sources.search import WorkspaceIndex
from tradeloom.staging import scratch

book = AnalysisBook.of_test_tables
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
stamp_sql = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

# ---- comparison ----------------------------------------------------------------------

KPI_COLS = {"revenue": "total_revenue", "units": "total_units", "margin": "avg_margin_pct", "sell_through": "avg_sell_through", "reorders": "reorder_count", "health": "health"}


def metric_sql(names, a, b, keys, source):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, cast({a(m)} as double) AS value_a, cast({b(m)} as double) AS value_b, round(cast({b(m)} as double) - {a(m)}, 4) AS diff, "
        f"case when {a(m)} <> 0 then round((cast({b(m)} as double) - {a(m)}) / {a(m)} * 100, 4) end AS pct FROM {source}" for m in names)


CTES["kpi_pairs"] = "SELECT p.a, p.b, " + ", ".join(f"x.{c} AS {m}_a, y.{c} AS {m}_b" for m, c in KPI_COLS.items()) + """
  FROM pairs p JOIN scored x ON x.dataset_id = p.a JOIN scored y ON y.dataset_id = p.b"""


@register("compare_datasets", metric_sql(KPI_COLS, lambda m: f"{m}_a", lambda m: f"{m}_b", "a, b", "kpi_pairs"))
def _(spark, d):
    b = book(spark, d).prepare("kpis")
    return compare.compare_datasets(b.pairs, b.kpis)


def outer(table, key):
    """Full outer match of both sides of every pair."""
    return f"""FROM (SELECT p.a, p.b, t.* FROM pairs p JOIN {table} t ON t.dataset_id = p.a) x
  FULL JOIN (SELECT p.a, p.b, t.* FROM pairs p JOIN {table} t ON t.dataset_id = p.b) y ON x.a = y.a AND x.b = y.b AND x.{key} = y.{key}"""


STATUS = "case when x.a is null then 'new' when y.a is null then 'dropped' else 'changed' end AS status"
CTES["cat_moves"] = f"""
  SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.category, y.category) AS category, {STATUS},
    coalesce(x.revenue, 0) AS rev_a, coalesce(y.revenue, 0) AS rev_b, round(coalesce(y.revenue, 0) - coalesce(x.revenue, 0), 2) AS rev_diff,
    coalesce(x.avg_sell_through, 0) AS st_a, coalesce(y.avg_sell_through, 0) AS st_b {outer('cats', 'category')}"""


@register("compare_categories", "SELECT * FROM cat_moves")
def _(spark, d):
    b = book(spark, d).prepare("kpis", "categories")
    return compare.compare_categories(b.pairs, b.categories)


@register("category_movement_top", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(rev_diff) DESC, category) AS rank FROM cat_moves) WHERE rank <= 25""")
def _(spark, d):
    b = book(spark, d).prepare("kpis", "categories")
    return compare.category_movement_top(compare.compare_categories(b.pairs, b.categories))


FIELDS = ["revenue", "units", "sell_through", "margin", "stock", "name", "category"]
CTES["sku_pool"] = """
  SELECT dataset_id, sku, 1 AS src, revenue, cast(units as double) AS units, sell_through, margin_pct AS margin, stock, name, category FROM best
  UNION ALL SELECT dataset_id, sku, 2, revenue, NULL, sell_through, NULL, NULL, name, category FROM markdown
  UNION ALL SELECT dataset_id, sku, 3, revenue, NULL, sell_through, NULL, stock, name, category FROM reorder"""
CTES["sku_index"] = "SELECT dataset_id, sku, " + ", ".join(f"arg_min({c}, src) FILTER ({c} IS NOT NULL) AS {c}" for c in FIELDS) + " FROM sku_pool GROUP BY 1, 2"


@register("sku_index", "SELECT * FROM sku_index")
def _(spark, d):
    return book(spark, d).sku_index


METRICS = ["revenue", "units", "sell_through", "margin"]
CTES["sku_pairs"] = f"""SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.sku, y.sku) AS entity, {STATUS}, coalesce(y.name, x.name, x.sku, y.sku) AS name,
  coalesce(y.category, x.category) AS category, {', '.join(f'x.{m} AS {m}_a, y.{m} AS {m}_b' for m in METRICS)} {outer('sku_index', 'sku')}"""


@register("compare_skus", metric_sql(METRICS, lambda m: f"{m}_a", lambda m: f"{m}_b", "a, b, entity, status, name, category", "sku_pairs"))
def _(spark, d):
    b = book(spark, d).prepare("kpis", "best_sellers", "markdown_risk", "reorder_alerts")
    return compare.compare_skus(b.pairs, b.sku_index)


CTES["cat_pairs"] = f"""SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.category, y.category) AS entity, {STATUS},
  x.revenue AS revenue_a, y.revenue AS revenue_b, x.units AS units_a, y.units AS units_b, x.avg_sell_through AS sell_through_a, y.avg_sell_through AS sell_through_b,
  x.avg_margin_pct AS margin_a, y.avg_margin_pct AS margin_b {outer('cats', 'category')}"""


@register("compare_category_entities", metric_sql(METRICS, lambda m: f"{m}_a", lambda m: f"{m}_b", "a, b, entity, status, entity AS name, entity AS category", "cat_pairs"))
def _(spark, d):
    b = book(spark, d).prepare("kpis", "categories")
    return compare.compare_category_entities(b.pairs, b.categories)


@register("union_skus", "SELECT DISTINCT a, b, sku FROM pairs JOIN sku_index ON dataset_id = a OR dataset_id = b")
def _(spark, d):
    b = book(spark, d).prepare("kpis", "best_sellers", "markdown_risk", "reorder_alerts")
    return compare.union_skus(b.pairs, b.sku_index)


word = lambda m, yes, no: f"case when {m}_b >= {m}_a then '{yes}' else '{no}' end"
REV_PCT = "((revenue_b - revenue_a) / revenue_a * 100)"
SAID = [
    f"{{'text': 'Revenue ' || {word('revenue', 'grew', 'fell')} || ' from ' || {pounds('revenue_a')} || ' to ' || {pounds('revenue_b')} || "
    f"case when revenue_a <> 0 then ' (' || {signed(REV_PCT, 1)} || '%).' else '.' end, 'tone': {word('revenue', 'good', 'bad')}}}",
    f"{{'text': 'Margin moved ' || {word('margin', 'up', 'down')} || ' from ' || {fixed('margin_a', 0)} || '% to ' || {fixed('margin_b', 0)} || '% — ' || "
    f"{word('margin', 'healthy full-price mix.', 'watch markdown depth.')}, 'tone': {word('margin', 'good', 'warn')}}}",
    f"{{'text': 'Business Health ' || {word('health', 'improved', 'declined')} || ' from ' || health_a || ' to ' || health_b || '.', 'tone': {word('health', 'good', 'bad')}}}",
    "case when up is not null or down is not null then {'text': concat_ws(' while ', up || ' strengthened', down || ' weakened') || ' — rebalance intake toward the winning categories.', 'tone': 'warn'} end",
]
two = lambda sign, name: f"""(SELECT a AS {name}_pa, b AS {name}_pb, string_agg(category, ', ' ORDER BY r) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(rev_diff) DESC, category) AS r
  FROM cat_moves WHERE rev_diff {sign} 0) WHERE r <= 2 GROUP BY 1, 2)"""


@register("compare_commentary", f"""
SELECT a, b, pos, s.text AS text, s.tone AS tone FROM (SELECT a, b, unnest(range(1, len(said) + 1)) AS pos, unnest(said) AS s FROM (
  SELECT a, b, [x for x in [{', '.join(SAID)}] if x IS NOT NULL] AS said FROM kpi_pairs
  LEFT JOIN {two('>', 'up')} ON up_pa = a AND up_pb = b LEFT JOIN {two('<', 'down')} ON down_pa = a AND down_pb = b))""")
def _(spark, d):
    b = book(spark, d).prepare("kpis", "categories")
    return compare.compare_commentary(b.pairs, b.kpis, b.categories)


# ---- development over time -----------------------------------------------------------


@register("timeline", f"SELECT * EXCLUDE (date), {stamp_sql('date')} AS date FROM points")
def _(spark, d):
    return book(spark, d).prepare("kpis").timeline.withColumn("date", stamp("date"))


def delta_sql(name, c, unit):
    return f"""SELECT user_id, dataset_id, seq, is_latest, '{name}' AS metric, case when {c} > prev_{c} then 'up' when {c} < prev_{c} then 'down' else 'flat' end AS direction,
      round(cast({c} as double) - prev_{c}, 1) AS change, round((cast({c} as double) - prev_{c}) / prev_{c} * 100, 1) AS pct, '{unit}' AS unit FROM moves WHERE coalesce(prev_{c}, 0) <> 0"""


@register("timeline_delta", " UNION ALL ".join(delta_sql(n, c, u) for n, (c, u) in timeline.METRICS.items()))
def _(spark, d):
    return timeline.timeline_delta(book(spark, d).prepare("kpis").timeline)


@register("business_memory", "SELECT * FROM memory")
def _(spark, d):
    return timeline.business_memory(book(spark, d).prepare("kpis").timeline)


CTES["risk_pairs"] = """SELECT *, lag(risks) OVER (PARTITION BY user_id ORDER BY date, dataset_id) AS prev FROM points JOIN risks USING (dataset_id)"""
RISK_SETS = {"new": ("[x for x in risks if NOT list_contains(prev, x)]", 3), "resolved": ("[x for x in prev if NOT list_contains(risks, x)]", 3),
             "recurring": ("[x for x in risks if list_contains(prev, x)]", 2)}


@register("risk_diff", " UNION ALL ".join(f"""SELECT user_id, dataset_id, '{k}' AS kind, unnest(range(1, least({n}, len(l)) + 1)) AS pos, unnest(l[1:{n}]) AS risk
  FROM (SELECT user_id, dataset_id, list_sort({s}) AS l FROM risk_pairs WHERE prev IS NOT NULL)""" for k, (s, n) in RISK_SETS.items()))
def _(spark, d):
    b = book(spark, d)
    risks = b.heads.select("dataset_id", role_view.risk_texts().alias("risks"))
    return timeline.risk_diff(b.timeline, risks)


TREND = lambda c: f"case when {c} is null then 'flat' when {c} >= 0 then 'up' else 'down' end"
PCT = lambda c: f"({signed(c, 1)} || '%')"
REVIEW = [
    ("overview", "Revenue", compact("revenue"), PCT("rd"), TREND("rd"), "case when rd is not null then 'vs last week' else 'this period' end"),
    ("overview", "Margin", fixed("margin", 1) + " || '%'", PCT("md"), TREND("md"), "'blended margin'"),
    ("overview", "Sell-Through", fixed("sell_through", 0) + " || '%'", PCT("sd"), TREND("sd"), "case when sd is not null then 'WoW' else 'range average' end"),
    ("overview", "Health Score", "health || '/100'", "(case when hd >= 0 then '+' else '' end || hd || ' pts')", TREND("hd"),
     "case when health >= 80 then 'Healthy' when health >= 60 then 'Watch' else 'At Risk' end"),
    ("change", "Revenue Movement", f"coalesce({PCT('rd')}, {compact('revenue')})", "NULL", TREND("rd"), text("Driven by {c} ({v})", c="top_cat", v=pounds("top_rev"))),
    ("change", "Margin Movement", f"coalesce({PCT('md')}, {fixed('margin', 1)} || '%')", "NULL", TREND("md"),
     "case when markdown_risk_count > 3 then 'Markdown dependency on slow movers' else 'Stable pricing across the range' end"),
    ("change", "Stock Position", "case when markdown_risk_count <> 0 then markdown_risk_count || ' SKUs flagged' else 'Clean' end", "NULL",
     "case when markdown_risk_count > 5 then 'down' else 'flat' end",
     f"case when markdown_risk_count <> 0 then {text('Slow/overstocked lines at ~{c} wks average cover', c=fixed('avg_cover_weeks', 0))} else {text('Healthy cover at ~{c} wks across the range', c=fixed('avg_cover_weeks', 0))} end"),
]
CTES["review_rows"] = """
  SELECT m.user_id, m.dataset_id, m.revenue, m.margin, m.sell_through, m.health, markdown_risk_count, avg_cover_weeks, top_cat, top_rev, period,
    (m.revenue - prev_revenue) / nullif(prev_revenue, 0) * 100 AS rd, m.margin - nullif(prev_margin, 0) AS md, m.sell_through - nullif(prev_sell_through, 0) AS sd, m.health - prev_health AS hd
  FROM moves m JOIN firsts f ON f.dataset_id = m.dataset_id
  JOIN (SELECT dataset_id AS pd, case when min(week) <> max(week) then min(week) || ' – ' || max(week) else min(week) end AS period FROM weekly GROUP BY 1) ON pd = m.dataset_id"""


@register("trading_review", " UNION ALL ".join(f"SELECT user_id, dataset_id, period, {i + 1} AS pos, '{s}' AS section, '{t}' AS title, {v} AS value, {dl} AS delta, {tr} AS trend, {n} AS note FROM review_rows"
                                               for i, (s, t, v, dl, tr, n) in enumerate(REVIEW)))
def _(spark, d):
    b = book(spark, d).prepare("kpis", "categories", "weekly")
    return timeline.trading_review(b.timeline, b.kpis, b.categories, b.weekly)


# ---- catalogue -----------------------------------------------------------------------


def flat(cards):
    """Cards with texts instead of timestamps and arrays."""
    return cards.withColumn("upload_date", stamp("upload_date")).drop("analysed_date").withColumn("tags", F.array_join("tags", ","))


CARD_SQL = f"SELECT * EXCLUDE (upload_date, tags), {stamp_sql('upload_date')} AS upload_date, array_to_string(tags, ',') AS tags FROM cards"


def cards(spark, d):
    b = book(spark, d).prepare("kpis")
    return workspace.dataset_cards(workspace.catalogue(b.datasets), b.kpis)


@register("dataset_card", CARD_SQL)
def _(spark, d):
    return flat(cards(spark, d))


@register("stock_value_estimate", "SELECT dataset_id, cast(round_even(total_revenue * 0.5 / 12, 0) as bigint) AS stock_value FROM kpis")
def _(spark, d):
    return book(spark, d).kpis.select("dataset_id", workspace.stock_value_estimate().alias("stock_value"))


VIEWS = {"active": "NOT archived AND NOT trashed", "archived": "archived AND NOT trashed", "trash": "trashed", "all": "NOT trashed"}
SEARCH = "(contains(lower(display_name || ' ' || filename), 'season') OR len([t for t in tags if contains(lower(t), 'season')]) > 0) AND len([t for t in tags if lower(t) = 'key']) > 0"


@register("workspace_filter", " UNION ALL ".join(
    [f"SELECT '{v}' AS search, dataset_id, display_name FROM cards WHERE {c}" for v, c in VIEWS.items()]
    + [f"SELECT 'tagged', dataset_id, display_name FROM cards WHERE NOT trashed AND {SEARCH}"]))
def _(spark, d):
    all_cards = cards(spark, d)
    shown = lambda df, name: df.select(F.lit(name).alias("search"), "dataset_id", "display_name")
    out = shown(workspace.workspace_filter(all_cards, "all", "Season", "KEY"), "tagged")
    for v in VIEWS:
        out = out.unionByName(shown(workspace.workspace_filter(all_cards, v), v))
    return out


FOUND = [("all", "Season", "KEY", SEARCH), ("active", "son 199", "", "contains(lower(display_name || ' ' || filename), 'son 199') OR len([t for t in tags if contains(lower(t), 'son 199')]) > 0"),
         ("archived", ".csv", "", "contains(lower(display_name || ' ' || filename), '.csv') OR len([t for t in tags if contains(lower(t), '.csv')]) > 0"),
         ("all", "ey", "", "contains(lower(display_name || ' ' || filename), 'ey') OR len([t for t in tags if contains(lower(t), 'ey')]) > 0"),
         ("trash", "", "key", "len([t for t in tags if lower(t) = 'key']) > 0")]


@register("workspace_search", " UNION ALL ".join(
    f"SELECT '{v}:{q}:{t}' AS search, dataset_id, display_name, revenue FROM cards WHERE ({VIEWS[v]}) AND ({c})" for v, q, t, c in FOUND))
def _(spark, d):
    """The index takes the cards in two parts; the second brings every third of them a second time."""
    index, all_cards = WorkspaceIndex(spark, scratch(spark, "workspace-index"), buckets=8), cards(spark, d)
    third = F.pmod(F.xxhash64("dataset_id"), F.lit(3)) == 0
    index.add(all_cards.withColumn("display_name", F.when(third, F.lit("Old season 1999 name")).otherwise(F.col("display_name"))))
    index.add(all_cards.where(third))
    found = [index.search(v, q, t).select(F.lit(f"{v}:{q}:{t}").alias("search"), "dataset_id", "display_name", "revenue") for v, q, t, _ in FOUND]
    return reduce(DataFrame.unionByName, found)


@register("workspace_counts", f"SELECT user_id, {', '.join(f'cast(count_if({VIEWS[v]}) as bigint) AS {v}' for v in ('active', 'archived', 'trash'))}, count(*) AS total FROM cards GROUP BY user_id")
def _(spark, d):
    return workspace.workspace_counts(cards(spark, d))


@register("tag_cloud", "SELECT user_id, tag, count(*) AS datasets FROM (SELECT user_id, unnest(tags) AS tag FROM cards WHERE NOT trashed) GROUP BY 1, 2")
def _(spark, d):
    return workspace.tag_cloud(cards(spark, d))


@register("scan_uploads", f"SELECT dataset_id, user_id, filename, {stamp_sql('created_at')} AS created_at, file_size FROM datasets")
def _(spark, d):
    return workspace.scan_uploads(book(spark, d).datasets).withColumn("created_at", stamp("created_at"))


@register("recent_uploads", f"""SELECT user_id, dataset_id, filename, {stamp_sql('created_at')} AS created_at, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, dataset_id DESC) AS rank FROM datasets) WHERE rank <= 20""")
def _(spark, d):
    return workspace.recent_uploads(book(spark, d).datasets).select("user_id", "dataset_id", "filename", stamp("created_at").alias("created_at"), "rank")


def asked(spark, d):
    """Requests for a dataset: half name one of their own or of another user, some carry a company."""
    b = book(spark, d)
    y = F.year("created_at")
    named = F.when(F.pmod(y, F.lit(3)) == 0, F.col("dataset_id")).when(F.pmod(y, F.lit(3)) == 1, F.concat(F.lit("BUILDING:"), y.cast("string")))
    company = F.when(F.pmod(y, F.lit(2)) == 0, F.when(F.pmod(y, F.lit(4)) == 0, F.lit("9")).otherwise(F.col("company_id")))
    return b, b.datasets.select("user_id", company.alias("company_id"), named.alias("dataset_id"))


CTES["asked"] = """SELECT user_id, case when y % 2 = 0 then case when y % 4 = 0 then '9' else company_id end end AS company_id,
  case when y % 3 = 0 then dataset_id when y % 3 = 1 then 'BUILDING:' || y end AS named FROM (SELECT *, year(created_at) AS y FROM datasets)"""


@register("latest_dataset", """
SELECT q.user_id, q.company_id, named, coalesce(
  (SELECT max(dataset_id) FROM datasets d WHERE d.user_id = q.user_id AND d.dataset_id = q.named AND (q.company_id IS NULL OR q.company_id = d.company_id)),
  (SELECT arg_max(dataset_id, created_at) FROM datasets d WHERE d.user_id = q.user_id AND (q.company_id IS NULL OR q.company_id = d.company_id))) AS dataset_id FROM asked q""")
def _(spark, d):
    b, requests = asked(spark, d)
    return workspace.latest_dataset(requests, b.datasets)


@register("workspace_switch_check", """
SELECT q.user_id, q.named AS dataset_id FROM asked q WHERE EXISTS (SELECT 1 FROM datasets d WHERE d.user_id = q.user_id AND d.dataset_id = q.named)""")
def _(spark, d):
    b, requests = asked(spark, d)
    return workspace.switch_check(requests, b.datasets).select("user_id", "dataset_id")


# Every dataset is changed twice; owners rename, tag, archive; changes of strangers are ignored.
@register("workspace_update", f"""
SELECT dataset_id, coalesce(case when y % 4 = 0 then 'Renamed ' || repeat('x', 130) when y % 4 = 1 then 'Plan B' end, display_name) AS display_name,
  case when y % 2 = 1 then 'late,' || repeat('t', 40) else array_to_string(tags, ',') end AS tags, case when y % 3 = 0 then true else archived end AS archived, trashed,
  '2024-01-15 00:00:00' AS updated_at FROM (SELECT *, year(created_at) AS y FROM datasets)""")
def _(spark, d):
    data = book(spark, d).datasets
    y = F.year("created_at")
    none = F.lit(None)
    when = lambda n, m, v: F.when(F.pmod(y, F.lit(n)) == m, v)
    first = data.select("dataset_id", "user_id", F.lit("2024-01-10").cast("timestamp_ntz").alias("ts"), when(4, 1, F.lit(" Plan A ")).alias("display_name"),
                        when(2, 1, F.array(F.lit("early"))).alias("tags"), when(3, 0, F.lit(True)).alias("archived"), none.cast("boolean").alias("trashed"))
    second = data.select("dataset_id", "user_id", F.lit("2024-01-11").cast("timestamp_ntz").alias("ts"),
                         when(4, 0, F.concat(F.lit("Renamed "), F.repeat(F.lit("x"), 130))).when(F.pmod(y, F.lit(4)) == 1, "Plan B").otherwise("  ").alias("display_name"),
                         when(2, 1, F.array(F.lit(" late "), F.lit("  "), F.repeat(F.lit("t"), 40))).alias("tags"), none.cast("boolean").alias("archived"), none.cast("boolean").alias("trashed"))
    stranger = second.withColumn("user_id", F.lit("someone")).withColumn("ts", F.lit("2024-01-12").cast("timestamp_ntz"))
    out = workspace.workspace_update(data, first.unionByName(second).unionByName(stranger), tt.as_of())
    return out.select("dataset_id", F.coalesce("workspace.display_name", none.cast("string")).alias("display_name"), F.array_join("workspace.tags", ",").alias("tags"),
                      "workspace.archived", "workspace.trashed", stamp("updated_at").alias("updated_at"))


@register("json_project", """
SELECT dataset_id, total_revenue, avg_sell_through, reorder_count, display_name, archived FROM (SELECT k.*, d.display_name, d.archived FROM kpis k JOIN datasets d ON d.dataset_id = k.dataset_id)""")
def _(spark, d):
    b = book(spark, d).prepare("kpis")
    stored = publish.stored_document(b.kpis, b.datasets)
    return publish.json_project(stored, "analysis", {
        "total_revenue": ("$.kpis.total_revenue", "double"), "avg_sell_through": ("$.kpis.avg_sell_through", "double"),
        "reorder_count": ("$.kpis.reorder_count", "bigint"), "display_name": ("$._workspace.display_name", "string"),
        "archived": ("$._workspace.archived", "boolean")})


@register("json_project_events", "SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events")
def _(spark, d):
    return publish.json_project(tt.table(spark, d, "events").select("event_id", "props"), "props", {"k": ("$.k", "bigint")})


def chat_sql(order, k):
    return f"""SELECT user_id, dataset_id, turn, role, content, position FROM (SELECT 'u' || conv_id % 20 AS user_id, cast(conv_id as varchar) AS dataset_id, turn, role, text AS content,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn {order}) AS position FROM conversations) WHERE position <= {k}"""


@register("chat_context", chat_sql("ASC", 5))
def _(spark, d):
    return workspace.chat_context(tt.chat_messages(spark, d), 5)


@register("chat_context_latest", chat_sql("DESC", 5))
def _(spark, d):
    return workspace.chat_context(tt.chat_messages(spark, d), 5, latest=True)
