"""Registered queries: tenancy, permissions, quotas, audit, retention, masking, file and text checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeloom.functions import crypto, text as tx
from tradeloom.operators import governance as gov, hygiene
from tradeloom.plans.blocks import AS_OF
from tradeloom.plans.book import STORED, AnalysisBook
from tradeloom.plans.registry import CTES, register
from tradeloom.sources import delimited, testtables as tt

# Patterns and messages in the SQL below are those results must match.
book = AnalysisBook.of_test_tables
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
stamp_sql = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

# ---- tenancy and permissions ---------------------------------------------------------


def visible_sql(rows, admin):
    base = f"""(SELECT count(*) FROM {rows} r WHERE r.company_id = p.company_id OR r.user_id = p.user_id)"""
    return f"SELECT user_id, " + (f"case when role = 'Admin' then (SELECT count(*) FROM {rows}) else {base} end" if admin else base) + " AS visible_rows FROM profiles p"


@register("tenant_scope", visible_sql("audit_logs", True))
def _(spark, d):
    return gov.tenant_scope(tt.audit_logs(spark, d), tt.profiles(spark, d), admin_sees_all=True)


@register("tenant_scope_profiles", """
SELECT user_id, case when company_id is null then 1 else (SELECT count(*) FROM profiles q WHERE q.company_id = p.company_id) end AS visible_rows FROM profiles p""")
def _(spark, d):
    p = tt.profiles(spark, d)
    return gov.tenant_scope(p, p)


@register("tenant_rows", """
SELECT log_id, user_id, company_id, action, status FROM audit_logs r WHERE company_id IN (SELECT company_id FROM profiles WHERE role = 'Director')
  OR user_id IN (SELECT user_id FROM profiles WHERE role = 'Director')""")
def _(spark, d):
    directors = tt.profiles(spark, d).where(F.col("role") == "Director")
    return gov.tenant_rows(tt.audit_logs(spark, d), directors).select("log_id", "user_id", "company_id", "action", "status")


VALUES = ", ".join(f"('{a}', '{r}')" for a, r in gov.PERMISSIONS.items())
LEVELS = ", ".join(f"('{r}', {n})" for r, n in gov.ROLE_LEVELS.items())


@register("rbac_allowed", f"""
SELECT user_id, p.role, action FROM profiles p JOIN (VALUES {LEVELS}) l(role, level) ON l.role = p.role
JOIN (SELECT action, level AS required FROM (VALUES {VALUES}) a(action, min_role) JOIN (VALUES {LEVELS}) m(role, level) ON m.role = min_role) ON l.level >= required""")
def _(spark, d):
    return gov.rbac_allowed(tt.profiles(spark, d))


def resources(spark, d):
    """One order per resource, owned by its customer, kept in the company of the order's number."""
    return tt.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("resource_id"),
        F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.pmod("o_orderkey", F.lit(25)).cast("string")).alias("company_id"))


@register("ownership_check", """
SELECT user_id, o_orderkey AS resource_id, coalesce(role = 'Admin' OR (p.company_id = case when o_orderkey % 7 <> 0 then cast(o_orderkey % 25 as varchar) end), false) AS allowed
FROM orders JOIN profiles p ON user_id = cast(o_custkey as varchar)""")
def _(spark, d):
    return gov.ownership_check(tt.profiles(spark, d), resources(spark, d))


@register("company_users", "SELECT company_id, user_id, email, full_name, role, is_active FROM profiles WHERE company_id IS NOT NULL")
def _(spark, d):
    return gov.company_users(tt.profiles(spark, d))


@register("private_mode_lookup", "SELECT user_id, coalesce(private_processing_mode, false) AS private_mode FROM profiles p LEFT JOIN companies c ON c.company_id = p.company_id")
def _(spark, d):
    return gov.private_mode_lookup(tt.profiles(spark, d), tt.companies(spark, d))


# ---- plans and quotas ----------------------------------------------------------------

LIMIT = lambda i, other: "case plan " + " ".join(f"when '{p}' then {v[i]}" for p, v in gov.PLAN_LIMITS.items()) + f" else {other} end"


@register("plan_limits_view", f"""
SELECT user_id, plan, ai_messages_used, {LIMIT(1, 5)} AS ai_messages_limit, {LIMIT(0, 10)} AS sku_limit, plan = 'trial' AND trial_ends < {AS_OF} AS trial_expired FROM profiles""")
def _(spark, d):
    return gov.plan_limits_view(tt.profiles(spark, d), tt.as_of())


@register("quota_check", f"""
SELECT user_id, plan, used, {LIMIT(1, 20)} AS message_limit, case when plan = 'trial' and trial_ends < {AS_OF} then 'trial_ended' when used >= {LIMIT(1, 20)} then 'messages_used_up' else 'ok' end AS message_decision,
  case when coalesce(n, 0) > {LIMIT(0, 50)} then 'over_sku_limit' else 'ok' end AS upload_decision
FROM (SELECT *, case when date_trunc('month', ai_messages_reset) < date_trunc('month', {AS_OF}) then 0 else ai_messages_used end AS used FROM profiles)
LEFT JOIN (SELECT cast(o_custkey as varchar) AS u, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) ON u = user_id""")
def _(spark, d):
    """SKUs of a customer's order lines stand for the SKUs of its upload."""
    bought = tt.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(
        tt.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = bought.select(F.col("o_custkey").cast("string").alias("user_id"), "l_partkey").distinct().groupBy("user_id").agg(F.count("*").alias("sku_count"))
    return gov.quota_check(tt.profiles(spark, d), per, tt.as_of())


@register("trial_state", f"""
SELECT user_id, plan, plan IN ('starter', 'growth', 'studio') AS is_paid,
  case when plan NOT IN ('starter', 'growth', 'studio') then cast(greatest(0, ceil(date_diff('second', {AS_OF}, trial_ends) / 86400.0)) as double) end AS days_left,
  plan NOT IN ('starter', 'growth', 'studio') AND trial_ends <= {AS_OF} AS expired FROM profiles""")
def _(spark, d):
    return gov.trial_state(tt.profiles(spark, d), tt.as_of())


@register("retention_valid", "SELECT o_orderkey, (o_orderkey * 97) % 12000 - 100 BETWEEN 1 AND 8760 AS valid FROM orders")
def _(spark, d):
    return tt.table(spark, d, "orders").select("o_orderkey", gov.retention_valid(F.pmod(F.col("o_orderkey") * 97, F.lit(12000)) - 100).alias("valid"))


@register("reset_monthly_quota", f"""
SELECT user_id, case when ai_messages_reset < date_trunc('month', {AS_OF}) then 0 else ai_messages_used end AS ai_messages_used,
  {stamp_sql(f"case when ai_messages_reset < date_trunc('month', {AS_OF}) then date_trunc('month', {AS_OF}) else ai_messages_reset end")} AS ai_messages_reset FROM profiles""")
def _(spark, d):
    return gov.reset_monthly_quota(tt.profiles(spark, d), tt.as_of()).select("user_id", "ai_messages_used", stamp("ai_messages_reset").alias("ai_messages_reset"))


@register("ai_usage_count", f"""
SELECT user_id, strftime(month, '%Y-%m') AS month, used, lim AS message_limit, used >= lim AS exhausted FROM (
  SELECT u.user_id, month, used, {LIMIT(1, 20)} AS lim FROM (SELECT cast(user_id as varchar) AS user_id, date_trunc('month', ts) AS month, count(*) AS used FROM events WHERE event_type = 'view' GROUP BY 1, 2) u
  LEFT JOIN profiles p ON p.user_id = u.user_id)""")
def _(spark, d):
    """view events stand for messages asked, all others for answers."""
    messages = tt.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts",
                                                   F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"))
    return gov.ai_usage_count(messages, tt.profiles(spark, d))


# ---- audit ---------------------------------------------------------------------------

AUDIT_COLS = ["log_id", "user_id", "company_id", "action", "status", "rank"]


def newest_sql(where, k):
    return f"""SELECT {', '.join(AUDIT_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY timestamp DESC, log_id DESC) AS rank FROM audit_logs WHERE {where}) WHERE rank <= {k}"""


@register("recent_audit", newest_sql("true", 500))
def _(spark, d):
    return gov.recent_audit(tt.audit_logs(spark, d), 500).select(AUDIT_COLS)


@register("audit_security_events", newest_sql("status IN ('FAILURE', 'BLOCKED')", 50))
def _(spark, d):
    return gov.audit_security_events(tt.audit_logs(spark, d)).select(AUDIT_COLS)


@register("audit_stats", """
SELECT company_id, action, count(*) AS total_events, cast(count_if(status IN ('FAILURE', 'BLOCKED')) as bigint) AS blocked_events FROM audit_logs
GROUP BY GROUPING SETS ((company_id), (company_id, action))""")
def _(spark, d):
    return gov.audit_stats(tt.audit_logs(spark, d))


@register("security_posture", """
SELECT c.company_id, private_processing_mode AS private_mode, cast(coalesce(retention_hours, 24) as int) AS retention_hours, coalesce(n, 0) AS total_events, coalesce(b, 0) AS blocked_events
FROM companies c LEFT JOIN (SELECT company_id AS cid, count(*) AS n, cast(count_if(status <> 'SUCCESS') as bigint) AS b FROM audit_logs GROUP BY 1) ON cid = c.company_id""")
def _(spark, d):
    return gov.security_posture(tt.companies(spark, d), tt.audit_logs(spark, d))


def raw_audit(spark, d):
    """Audit entries as they arrive: long agents, odd statuses, proxy headers."""
    e = tt.audit_logs(spark, d).withColumn("user_agent", F.when(F.pmod("log_id", F.lit(3)) != 0, F.repeat(F.lit("agent/"), 100)))
    e = e.withColumn("status", F.when(F.pmod("log_id", F.lit(11)) == 0, "PENDING").otherwise(F.col("status")))
    return e.withColumn("resource", F.concat(F.lit("upload:"), F.col("log_id").cast("string")))


@register("audit_append", """
SELECT log_id, status, case when log_id % 3 <> 0 then repeat('agent/', 100) else '' end AS user_agent, 'upload:' || log_id AS resource, metadata FROM audit_logs WHERE log_id % 11 <> 0""")
def _(spark, d):
    valid, _ = gov.audit_records(raw_audit(spark, d))
    return valid.select("log_id", "status", "user_agent", "resource", "metadata")


@register("audit_rejects", "SELECT log_id, 'PENDING' AS status FROM audit_logs WHERE log_id % 11 = 0")
def _(spark, d):
    _, rejects = gov.audit_records(raw_audit(spark, d))
    return rejects.select("log_id", "status")


@register("client_ip", """
SELECT event_id, case when event_id % 4 = 0 then '10.0.' || user_id || '.1' when event_id % 4 = 1 then '172.16.0.' || user_id when event_id % 4 = 2 then '192.168.1.' || user_id
  when event_id % 8 = 3 then 'peer' else 'unknown' end AS ip FROM events""")
def _(spark, d):
    u = F.col("user_id").cast("string")
    kind = lambda n: F.pmod("event_id", F.lit(4)) == n
    forwarded = F.when(kind(0), F.concat(F.lit(" 10.0."), u, F.lit(".1 , 10.9.9.9"))).otherwise("")
    proxy = F.when(kind(1), F.concat(F.lit("172.16.0."), u))
    real = F.when(kind(2) | kind(1), F.concat(F.lit("192.168.1."), u)).otherwise("")
    remote = F.when(F.pmod("event_id", F.lit(8)) == 3, "peer")
    return tt.table(spark, d, "events").select("event_id", gov.client_ip(forwarded, proxy, real, remote).alias("ip"))


# ---- retention and backfills ---------------------------------------------------------

CTES["kept"] = """SELECT d.*, cast(coalesce(c.retention_hours, 24) as int) AS hours, d.created_at + to_hours(cast(coalesce(c.retention_hours, 24) as int)) AS expires_at
  FROM datasets d LEFT JOIN companies c ON c.company_id = d.company_id"""


@register("retention_lookup", f"SELECT dataset_id, hours AS retention_hours, {stamp_sql('expires_at')} AS expires_at FROM kept")
def _(spark, d):
    return gov.retention_lookup(book(spark, d).datasets, tt.companies(spark, d)).select("dataset_id", "retention_hours", stamp("expires_at").alias("expires_at"))


@register("expire_uploads", "SELECT dataset_id, expires_at < TIMESTAMP '2000-01-01 00:00:00' AS newly_expired, case when expires_at < TIMESTAMP '2000-01-01 00:00:00' then '2000-01-01 00:00:00' end AS deleted_at FROM kept")
def _(spark, d):
    kept = gov.retention_lookup(book(spark, d).datasets, tt.companies(spark, d))
    return gov.expire_uploads(kept, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("dataset_id", "newly_expired", stamp("deleted_at").alias("deleted_at"))


@register("backfill_company", "SELECT user_id, coalesce(company_id, substr(sha256(user_id), 1, 32)) AS company_id, case when company_id is null then split_part(email, '@', 2) end AS new_company FROM profiles")
def _(spark, d):
    created, linked = gov.backfill_company(tt.profiles(spark, d))
    return linked.select("user_id", "company_id").join(created.select("company_id", F.col("name").alias("new_company")), "company_id", "left").select("user_id", "company_id", "new_company")


@register("backfill_chat_company", """
SELECT conv_id, turn, coalesce(case when conv_id % 3 = 0 then 'own' end, company_id) AS company_id FROM conversations LEFT JOIN datasets
ON dataset_id = ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][conv_id % 5 + 1] || ':' || (1995 + conv_id % 9)""")
def _(spark, d):
    seg = F.element_at(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    chats = tt.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.pmod("conv_id", F.lit(3)) == 0, "own").alias("company_id"),
        F.concat_ws(":", seg, (F.lit(1995) + F.pmod("conv_id", F.lit(9))).cast("string")).alias("dataset_id"))
    return gov.backfill_from(chats, book(spark, d).datasets, "dataset_id").select("conv_id", "turn", "company_id")


CTES["signups"] = """SELECT cast(user_id * 20 as varchar) AS user_id, ts, 'New.' || user_id || '@Shop.example' AS email, case when user_id % 2 = 0 then 'Name ' || user_id end AS given
  FROM events WHERE event_type = 'signup'"""


@register("profile_seed", f"""
SELECT coalesce(p.user_id, s.user_id) AS user_id, coalesce(s.email, p.email) AS email, coalesce(s.name, p.full_name) AS full_name, coalesce(p.plan, 'trial') AS plan,
  {stamp_sql(f"coalesce(p.trial_ends, {AS_OF} + to_days(14))")} AS trial_ends
FROM profiles p FULL JOIN (SELECT user_id, arg_max(email, ts) AS email, arg_max(coalesce(given, split_part(email, '@', 1)), ts) AS name FROM signups GROUP BY 1) s ON s.user_id = p.user_id""")
def _(spark, d):
    """Sign-up events; every twentieth customer number exists as a profile, larger ones are new."""
    u = F.col("user_id")
    meta = F.when(F.pmod(u, F.lit(2)) == 0, F.concat(F.lit('{"full_name":"Name '), u.cast("string"), F.lit('"}'))).otherwise("{}")
    signups = tt.table(spark, d, "events").where(F.col("event_type") == "signup").select(
        (u * 20).cast("string").alias("user_id"), "ts", F.concat(F.lit("New."), u.cast("string"), F.lit("@Shop.example")).alias("email"), meta.alias("metadata"))
    return gov.profile_seed(signups, tt.profiles(spark, d), tt.as_of()).withColumn("trial_ends", stamp("trial_ends"))


def changes(spark, d):
    """purchase events change retention hours, clicks the private mode; some values are invalid."""
    e = tt.table(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    hours = (F.pmod(F.col("event_id") * 37, F.lit(10000))).cast("string")
    mode = F.when(F.pmod("event_id", F.lit(5)) == 0, "maybe").when(F.pmod("event_id", F.lit(2)) == 0, "true").otherwise("false")
    bought = F.col("event_type") == "purchase"
    return e.select(F.pmod("user_id", F.lit(25)).cast("string").alias("company_id"), "ts", F.col("event_id").alias("change_id"),
                    F.when(bought, "retention_hours").otherwise("private_processing_mode").alias("setting"), F.when(bought, hours).otherwise(mode).alias("value"))


CTES["valid_changes"] = """SELECT * FROM (SELECT cast(user_id % 25 as varchar) AS company_id, ts, event_id AS change_id, case event_type when 'purchase' then 'retention_hours' else 'private_processing_mode' end AS setting,
    case when event_type = 'purchase' then cast(event_id * 37 % 10000 as varchar) when event_id % 5 = 0 then 'maybe' when event_id % 2 = 0 then 'true' else 'false' end AS value FROM events WHERE event_type IN ('purchase', 'click'))
  WHERE case when setting = 'retention_hours' then cast(value as int) between 1 and 8760 else value <> 'maybe' end"""


@register("settings_apply", """
SELECT c.company_id, cast(coalesce(h, retention_hours) as double) AS retention_hours, coalesce(m = 'true', private_processing_mode) AS private_processing_mode
FROM companies c LEFT JOIN (SELECT company_id AS cid, try_cast(arg_max(value, ts) FILTER (setting = 'retention_hours') as int) AS h,
  arg_max(value, ts) FILTER (setting <> 'retention_hours') AS m FROM valid_changes GROUP BY 1) ON cid = c.company_id""")
def _(spark, d):
    after, _ = gov.settings_apply(tt.companies(spark, d), changes(spark, d), tt.as_of())
    return after.select("company_id", F.col("retention_hours").cast("double").alias("retention_hours"), "private_processing_mode")


@register("settings_audit", """
SELECT v.company_id, change_id, 'SETTINGS_CHANGED' AS action, setting, case when setting = 'retention_hours' then cast(retention_hours as varchar) else cast(private_processing_mode as varchar) end AS old_value, value AS new_value
FROM valid_changes v JOIN companies c ON c.company_id = v.company_id""")
def _(spark, d):
    _, trail = gov.settings_apply(tt.companies(spark, d), changes(spark, d), tt.as_of())
    return trail.drop("ts")


@register("role_changes", """
SELECT p.user_id, 'ROLE_CHANGE' AS action, role AS from_role, to_role FROM profiles p JOIN (
  SELECT cast(user_id as varchar) AS u, arg_max(r, ts) AS to_role FROM (SELECT *, ['MA', 'AM', 'Merchandiser', 'Director', 'Admin', 'Guest'][event_id % 6 + 1] AS r FROM events)
  WHERE r NOT IN ('Admin', 'Guest') GROUP BY 1) ON u = p.user_id""")
def _(spark, d):
    wanted = F.element_at(F.array(*[F.lit(r) for r in (*gov.ROLE_LEVELS, "Guest")]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    asked = tt.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts", F.col("event_id").alias("change_id"), wanted.alias("role"))
    return gov.role_changes(tt.profiles(spark, d), asked)[1]


# ---- masking -------------------------------------------------------------------------


def items(spark, d):
    s = tt.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tt.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("sku"), F.col("l_extendedprice").alias("revenue"), F.when(F.pmod("l_orderkey", F.lit(9)) != 0, F.col("s_name")).otherwise("").alias("Supplier"),
        F.col("l_suppkey").alias("vendor_id"), F.col("s_acctbal").alias("contract_price"), F.lit("call me").alias("buyer notes"), F.col("l_linenumber").alias("line"))


ALIAS = lambda c: f"case when {c} <> '' then 'VENDOR-' || upper(substr(sha256({c}), 1, 8)) end"


@register("mask_standard", f"""
SELECT l_partkey AS sku, l_extendedprice AS revenue, {ALIAS("case when l_orderkey % 9 <> 0 then s_name else '' end")} AS "Supplier", {ALIAS("cast(l_suppkey as varchar)")} AS vendor_id, l_linenumber AS line
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def _(spark, d):
    return gov.mask_standard(items(spark, d))


PRIVATE = """SELECT k.dataset_id, k.sku_count, total_revenue, total_units, gross_profit, k.avg_sell_through, k.avg_margin_pct, gross_margin_pct, margin_available, margin_source, avg_cover_weeks,
  reorder_count, markdown_risk_count, critical_oos_count, coalesce(n, 0) AS category_count, coalesce(r, 0) AS listed_reorders, coalesce(m, 0) AS listed_markdowns, c.health, c.revenue AS category_revenue, c.avg_sell_through AS category_sell_through, c.avg_margin_pct AS category_margin_pct, c.sku_count AS category_skus
FROM kpis k LEFT JOIN (SELECT dataset_id AS rd, count(*) AS r FROM reorder GROUP BY 1) ON rd = k.dataset_id LEFT JOIN (SELECT dataset_id AS md, count(*) AS m FROM markdown GROUP BY 1) ON md = k.dataset_id
LEFT JOIN (SELECT dataset_id AS nd, count(*) AS n FROM cats GROUP BY 1) ON nd = k.dataset_id LEFT JOIN cats c ON c.dataset_id = k.dataset_id"""
SECTIONS = {"best_sellers": "best", "reorder_alerts": "reorder", "markdown_risk": "markdown"}


@register("mask_private", PRIVATE)
def _(spark, d):
    b = book(spark, d).prepare(*STORED)
    return gov.mask_private(b.kpis, b.categories, b.reorder_alerts, b.markdown_risk)


@register("mask_dispatch", " UNION ALL ".join(
    f"SELECT dataset_id, 'standard' AS mode, '{k}' AS section, sku, cast(rank as bigint) AS place FROM {t} WHERE dataset_id NOT IN (SELECT pd FROM private_sets)" for k, t in SECTIONS.items())
    + " UNION ALL SELECT dataset_id, 'private', 'categories', NULL, sku_count FROM cats JOIN private_sets ON pd = dataset_id")
def _(spark, d):
    """What may leave: items of ordinary companies, figures per category of private ones."""
    b = book(spark, d).prepare(*STORED)
    private = b.private_datasets(tt.companies(spark, d))
    tables = {"best_sellers": b.best_sellers, "reorder_alerts": b.reorder_alerts, "markdown_risk": b.markdown_risk}
    shown = [gov.outgoing_items(t, private).select("dataset_id", F.lit("standard").alias("mode"), F.lit(k).alias("section"), "sku", F.col("rank").cast("bigint").alias("place")) for k, t in tables.items()]
    figures = gov.mask_private(b.kpis, b.categories, b.reorder_alerts, b.markdown_risk).join(private, "dataset_id", "left_semi")
    shown.append(figures.select("dataset_id", F.lit("private").alias("mode"), F.lit("categories").alias("section"), F.lit(None).cast("string").alias("sku"), F.col("category_skus").cast("bigint").alias("place")))
    return reduce(DataFrame.unionByName, shown)


# ---- files and texts -----------------------------------------------------------------

CTES["files"] = """
  SELECT 'page_' || page_id || ['.csv', '.txt', '.exe', '.xlsx', ''][page_id % 5 + 1] AS filename, html AS body FROM pages
  UNION ALL SELECT 'doc_' || doc_id || ['.csv', '.txt', '.exe', '.xlsx', ''][doc_id % 5 + 1], text FROM documents"""
BARE = "regexp_replace(regexp_replace(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
NUMERIC = "regexp_full_match(regexp_replace(c, '[£$€%, ()]', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


# Fixed values, written out here so that the check doesn't rest on the list under test.
FILE_PATTERNS = ["<script", "<?php", "vbscript", "shell(", "wscript", "ddeauto", "powershell", "cmd.exe", "subprocess"]


def scan_sql(head, cells_text, lines):
    hits = " OR ".join(f"contains(lower({head}), '{p}')" for p in FILE_PATTERNS)
    return f"""
SELECT filename, coalesce(stage, 'accepted') AS verdict, stage IS NULL AS valid, false AS large, size FROM (
  SELECT filename, size, case when size = 0 then 'empty' when not contains(filename, '.') then 'no_extension' when ext not in ('csv', 'numbers', 'ods', 'tsv', 'txt', 'xls', 'xlsx') then 'extension_not_allowed'
    when ext = 'xlsx' and not starts_with(body, 'PK' || chr(3) || chr(4)) then 'signature_mismatch' when starts_with(body, 'MZ' || chr(144)) or {hits} then 'dangerous_content'
    when ext in ('csv', 'txt') and len([b for b in [{BARE} for c in cells] if b[1] in ('=', '@') or (b[1] in ('+', '-') and not {NUMERIC.replace('(c,', '(b,')})]) / cast(greatest(len(cells), 1) as double) > 0.05 then 'formula_injection' end AS stage
  FROM (SELECT *, flatten([string_split(l, ',') for l in lines]) AS cells FROM (SELECT *, {lines} AS lines FROM (SELECT *, strlen(body) AS size, case when contains(filename, '.') then split_part(filename, '.', 2) else '' end AS ext,
    case when ends_with({cells_text}, chr(10)) then {cells_text}[:-2] else {cells_text} end AS shown FROM files))))"""


@register("file_scan_whole", scan_sql("body", "body", "string_split(shown, chr(10))"))
def _(spark, d):
    return hygiene.file_scan(tt.file_contents(spark, d))


@register("file_scan", scan_sql("body", "body", "string_split(shown, chr(10))"))
def _(spark, d):
    return hygiene.file_scan(tt.file_contents(spark, d))


SHEET = "string_agg(cell, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
CELLS = """case (l_partkey + l_linenumber) % 23 when 0 then '=SUM(A1)' when 1 then '-20%' when 2 then '+15.5' when 3 then '"-1,2"' when 4 then '@cmd' when 5 then '-cmd' when 6 then '' else 'plain' end"""


@register("csv_injection_scan", f"""
SELECT sheet, bad / cast(n as double) AS share, bad / cast(n as double) > 0.05 AS rejected FROM (
  SELECT l_suppkey AS sheet, count(*) + cast(count_if((l_partkey + l_linenumber) % 23 = 3) as bigint) AS n, cast(count_if((l_partkey + l_linenumber) % 23 IN (0, 4, 5)) as bigint) AS bad
  FROM lineitem GROUP BY l_suppkey)""")
def _(spark, d):
    """One sheet per supplier and order, one cell per line; shares add up per supplier."""
    k = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(23))
    cell = F.lit("plain")
    for i, v in enumerate(["=SUM(A1)", "-20%", "+15.5", '"-1,2"', "@cmd", "-cmd", ""]):
        cell = F.when(k == i, F.lit(v)).otherwise(cell)
    rows = tt.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), cell.cast("binary").alias("content"))
    share = hygiene.csv_injection_share(F.col("content"), F.lit("csv"))
    cells = F.size(F.split(F.col("content").cast("string"), ","))
    per = rows.groupBy("sheet").agg(F.sum(F.bround(share * cells, 0).cast("bigint")).alias("bad"), F.sum(cells).alias("n"))
    ratio = F.col("bad").cast("double") / F.col("n")
    return per.select("sheet", ratio.alias("share"), (ratio > hygiene.CELL_SHARE).alias("rejected"))


ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register("sanitise_text", f"SELECT page_id, {ESC('trim(nfc_normalize(html))')} AS clean FROM pages")
def _(spark, d):
    return tt.table(spark, d, "pages").select("page_id", tx.page_text(F.col("html")).alias("clean"))


@register("validate_fields", """
SELECT user_id, regexp_full_match(email, '[a-zA-Z0-9._%+\\-]{1,64}@[a-zA-Z0-9.\\-]{1,253}\\.[a-zA-Z]{2,}') AS email_ok,
  case when length(pw) < 8 then 'Password must be at least 8 characters.' when not regexp_matches(pw, '[A-Z]') then 'Password must contain at least one uppercase letter.'
    when not regexp_matches(pw, '[0-9]') then 'Password must contain at least one number.' end AS password_problem,
  regexp_full_match(uid, '[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') AS uuid_ok
FROM (SELECT user_id, case when cast(user_id as bigint) % 6 = 0 then replace(email, '@', ' at ') else email end AS email,
  ['short', 'nouppercase1', 'NoDigitsHere', 'Good1Password'][cast(user_id as bigint) % 4 + 1] AS pw, lower(h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || h[17:20] || '-' || h[21:32]) AS uid
  FROM (SELECT *, sha256(user_id) AS h FROM profiles))""")
def _(spark, d):
    n = F.col("user_id").cast("bigint")
    email = F.when(F.pmod(n, F.lit(6)) == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email"))
    pw = F.element_at(F.array(*[F.lit(x) for x in ("short", "nouppercase1", "NoDigitsHere", "Good1Password")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    h = F.upper(F.sha2("user_id", 256))
    part = lambda a, b: F.substring(h, a, b - a + 1)
    uid = F.concat(part(1, 8), F.lit("-"), part(9, 12), F.lit("-4"), part(14, 16), F.lit("-"), part(17, 20), F.lit("-"), part(21, 32))
    return tt.profiles(spark, d).select("user_id", tx.valid_email(email).alias("email_ok"), tx.password_problem(pw).alias("password_problem"), tx.valid_uuid(uid).alias("uuid_ok"))


@register("safe_filename", """
SELECT o_orderkey, ['data.csv', 'a_b_c_.txt', 'hidden.xlsx', 'upload', 'evil.csv', 'plain'][o_orderkey % 6 + 1] AS name FROM orders""")
def _(spark, d):
    raw = F.array(*[F.lit(x) for x in ("../../etc/data.csv", 'a:b*c?.txt', "...hidden.xlsx", "", "C:\\tmp\\ev\x00il.csv", "plain")])
    return tt.table(spark, d, "orders").select("o_orderkey", tx.safe_filename(F.element_at(raw, (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))).alias("name"))


SQLI = r"(?is)(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION|TRUNCATE|GRANT|REVOKE)\b|--\s|;\s*--|/\*.*?\*/|\bOR\b\s+\d+\s*=\s*\d+|\bAND\b\s+\d+\s*=\s*\d+)"
XSS = r"(?i)(<script|javascript:|vbscript:|data:text/html|on\w+\s*=)"


@register("injection_flags", f"""
SELECT filename, regexp_matches(body, '{SQLI}') AS sql_injection, regexp_matches(body, '{XSS}') AS xss FROM
  (SELECT filename, case when length(body) % 10 = 0 then body || ' ; DROP table x' else body end AS body FROM files)""")
def _(spark, d):
    """Whole texts; every tenth, by length, gets a planted statement."""
    t = F.col("content").cast("string")
    body = F.when(F.pmod(F.length(t), F.lit(10)) == 0, F.concat(t, F.lit(" ; DROP table x"))).otherwise(t)
    return tt.file_contents(spark, d).select("filename", tx.has_sql_injection(body).alias("sql_injection"), tx.has_xss(body).alias("xss"))


@register("encrypt_column", "SELECT doc_id, true AS same, strlen(text) + 28 AS blob_bytes, sha256(text) AS digest FROM documents")
def _(spark, d):
    """Round trip of every text; the key is derived in the plan for the check."""
    key = F.unhex(F.sha2(F.lit("check key"), 256))
    t = F.col("text")
    blob = crypto.encrypt(t.cast("binary"), key)
    back = crypto.decrypt_text(crypto.encrypt_text(t, key), key)
    return tt.table(spark, d, "documents").select("doc_id", (back == t).alias("same"), F.length(blob).cast("bigint").alias("blob_bytes"), crypto.sha256_hex(t).alias("digest"))


@register("encrypt_json", "SELECT doc_id, lang, source, n_chars, true AS hidden FROM documents")
def _(spark, d):
    """Round trip of three fields as one encrypted JSON value."""
    key = F.unhex(F.sha2(F.lit("check key"), 256))
    blob = crypto.encrypt_json(F.struct("lang", "source", "n_chars"), key)
    rows = tt.table(spark, d, "documents").withColumn("blob", blob)
    back = crypto.decrypt_json(F.col("blob"), key, "lang string, source string, n_chars bigint")
    return rows.select("doc_id", back.alias("b"), (~F.contains("blob", F.lit("source"))).alias("hidden")).select("doc_id", "b.*", "hidden")


@register("validate_role", """
SELECT user_id, asked IN ('MA', 'AM', 'Merchandiser', 'Director', 'Admin') AS ok FROM (
  SELECT user_id, CASE cast(user_id as bigint) % 4 WHEN 0 THEN role WHEN 1 THEN lower(role) WHEN 2 THEN ' ' || role || ' ' ELSE 'Owner' END AS given,
    CASE cast(user_id as bigint) % 4 WHEN 0 THEN role WHEN 1 THEN lower(role) WHEN 2 THEN role ELSE 'Owner' END AS asked FROM profiles)""")
def _(spark, d):
    n = F.col("user_id").cast("bigint") % 4
    given = F.when(n == 0, F.col("role")).when(n == 1, F.lower("role")).when(n == 2, F.concat(F.lit(" "), "role", F.lit(" "))).otherwise("Owner")
    return tt.profiles(spark, d).select("user_id", gov.valid_role(given).alias("ok"))


@register("pick_best_table", """
SELECT dataset_id, position, score FROM (SELECT dataset_id, position, score, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, position) AS r FROM (
  SELECT cast(l_orderkey as varchar) AS dataset_id, l_linenumber * 100000000 + l_partkey AS position, max([2, 3, 1, 0][l_partkey % 4 + 1]) AS score FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def _(spark, d):
    """Every order line stands for a table of its order's workbook, with one of four headers."""
    kinds = [["SKU", "Product Code x", "Unit s Sold", "notes"], ["sku", "Net", "Units_Sold", "Re venue"], ["Stock On Hand", "colour"], ["a", "b"]]
    heads = F.array(*[F.array(*[F.lit(h) for h in k]) for k in kinds])
    tables = tt.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("dataset_id"), (F.col("l_linenumber") * F.lit(100000000).cast("bigint") + F.col("l_partkey")).alias("position"),
        F.element_at(heads, (F.pmod("l_partkey", F.lit(4)) + 1).cast("int")).alias("headers"))
    return delimited.pick_best_table(tables)
