"""Tenancy, permissions, quotas, audit and retention over profile, company and audit tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.operators.alerts import top_per
from tradeloom.staging import staged

# Roles by rising level.
ROLE_LEVELS = {"MA": 1, "AM": 2, "Merchandiser": 3, "Director": 4, "Admin": 5}
# Lowest role allowed to perform each action.
PERMISSIONS = {
    "view_dashboard": "MA", "upload_file": "MA", "view_analysis": "MA", "view_own_uploads": "MA",
    "ai_chat": "MA", "view_quick_insights": "MA", "view_ai_insights": "AM",
    "view_report": "AM", "generate_report": "AM", "export_report_pdf": "AM", "export_report_pptx": "AM",
    "view_action_centre": "Merchandiser", "action_centre_api": "Merchandiser",
    "view_security_centre": "Director", "view_audit_logs": "Director", "view_all_users": "Director",
    "change_retention_policy": "Director", "toggle_private_mode": "Director",
    "manage_users": "Admin", "change_user_role": "Admin", "suspend_user": "Admin", "delete_uploads_any": "Admin",
    "change_own_profile": "MA",
}
# SKUs per dataset and assistant messages per month of each plan.
PLAN_LIMITS = {"trial": (50, 20), "starter": (200, 50), "growth": (999999, 999999), "studio": (999999, 999999)}
# Limits shown for plans outside that list.
OTHER_PLAN_LIMITS = (10, 5)
PAID_PLANS = ["starter", "growth", "studio"]
AUDIT_STATUSES = ["SUCCESS", "FAILURE", "BLOCKED"]
DEFAULT_RETENTION_HOURS, MAX_RETENTION_HOURS, TRIAL_DAYS = 24, 8760, 14
SECURITY_EVENTS_KEPT = 50


def valid_role(text: Column) -> Column:
    """Whether a text names a role, spaces around it aside."""
    return F.coalesce(F.trim(text).isin(list(ROLE_LEVELS)), F.lit(False))


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Small constant table built inside the plan."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def role_level(role: Column) -> Column:
    rule = F.lit(0)
    for name, level in ROLE_LEVELS.items():
        rule = F.when(role == name, level).otherwise(rule)
    return rule


def has_permission(role: Column, action: Column) -> Column:
    """False for unknown actions and unknown roles."""
    required = F.lit(None).cast("int")
    for name, least in PERMISSIONS.items():
        required = F.when(action == name, ROLE_LEVELS[least]).otherwise(required)
    return F.coalesce(role_level(role) >= required, F.lit(False))


def rbac_allowed(users: DataFrame) -> DataFrame:
    """Allowed actions per user: each role level is at or above the action's least level.

    The level test runs once per (role, action) between two constant tables; users then
    meet the result by an equi-join with a side of fixed size.
    """
    spark = users.sparkSession
    roles = literal_table(spark, ["role", "level"], list(ROLE_LEVELS.items()))
    actions = literal_table(spark, ["action", "required"], [(a, ROLE_LEVELS[r]) for a, r in PERMISSIONS.items()])
    granted = roles.join(F.broadcast(actions), F.col("level") >= F.col("required")).select("role", "action")
    return users.select("user_id", "role").join(F.broadcast(granted), "role").select("user_id", "role", "action")


def owns(user_role: Column, user_company: Column, resource_company: Column) -> Column:
    """Admin passes; others need two equal, non-empty companies."""
    filled = lambda c: c.isNotNull() & (c.cast("string") != "")
    same = filled(user_company) & filled(resource_company) & (user_company.cast("string") == resource_company.cast("string"))
    return (user_role == "Admin") | F.coalesce(same, F.lit(False))


def ownership_check(profiles: DataFrame, resources: DataFrame) -> DataFrame:
    """Whether the owner of each resource may reach it through its company."""
    who = profiles.select(F.col("user_id"), "role", F.col("company_id").alias("user_company"))
    return resources.join(who, "user_id").select(
        "user_id", "resource_id", owns(F.col("role"), F.col("user_company"), F.col("company_id")).alias("allowed"))


def tenant_rows(rows: DataFrame, principal: DataFrame) -> DataFrame:
    """Rows at least one of the given principals may see: own rows and rows of their company.

    The OR of the two conditions is split into two semi-joins on equal keys; the second
    takes only rows the first leaves out, so nothing appears twice.
    """
    company = principal.where(F.col("company_id").isNotNull()).select("company_id").distinct()
    users = principal.select("user_id").distinct()
    by_company = rows.join(company, "company_id", "left_semi")
    by_user = rows.join(company, "company_id", "left_anti").join(users, "user_id", "left_semi")
    return by_company.unionByName(by_user.select(*by_company.columns))


def tenant_scope(rows: DataFrame, principals: DataFrame, admin_sees_all: bool = False) -> DataFrame:
    """Number of rows each principal may see, without listing (principal, row) pairs.

    Visible = rows of the company + own rows outside it. The rows are read once, into counts
    per user and company; all other counts are sums of these, so a company holding a third of
    all rows costs one counter.
    """
    both = staged(rows.groupBy("user_id", "company_id").agg(F.count("*").alias("own_in_company")), "scope-counts")
    per_company = both.where(F.col("company_id").isNotNull()).groupBy("company_id").agg(F.sum("own_in_company").alias("in_company"))
    per_user = both.groupBy("user_id").agg(F.sum("own_in_company").alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = zero("in_company") + zero("own") - zero("own_in_company")
    out = principals.join(per_company, "company_id", "left").join(per_user, "user_id", "left").join(
        both, ["user_id", "company_id"], "left")
    if admin_sees_all:
        seen = F.when(F.col("role") == "Admin", both.agg(F.coalesce(F.sum("own_in_company"), F.lit(0))).scalar()).otherwise(seen)
    return out.select("user_id", seen.cast("bigint").alias("visible_rows"))


def plan_limits_view(profiles: DataFrame, now: Column) -> DataFrame:
    def limit(i):
        rule = F.lit(OTHER_PLAN_LIMITS[i])
        for plan, values in PLAN_LIMITS.items():
            rule = F.when(F.col("plan") == plan, values[i]).otherwise(rule)
        return rule
    return profiles.select(
        "user_id", "plan", "ai_messages_used", limit(1).alias("ai_messages_limit"), limit(0).alias("sku_limit"),
        F.coalesce((F.col("plan") == "trial") & (F.col("trial_ends") < now), F.lit(False)).alias("trial_expired"))


def plan_limit(plan: Column, i: int) -> Column:
    """Limit of a plan, unknown plans counting as trial (0: SKUs, 1: messages)."""
    rule = F.lit(PLAN_LIMITS["trial"][i])
    for name, values in PLAN_LIMITS.items():
        rule = F.when(plan == name, values[i]).otherwise(rule)
    return rule


def quota_check(profiles: DataFrame, sku_counts: DataFrame, now: Column) -> DataFrame:
    """Decision per profile on its next message and on its largest dataset."""
    expired = (F.col("plan") == "trial") & F.col("trial_ends").isNotNull() & (now > F.col("trial_ends"))
    used = F.when(F.date_trunc("month", "ai_messages_reset") < F.date_trunc("month", now), F.lit(0)).otherwise(F.col("ai_messages_used"))
    df = profiles.join(sku_counts, "user_id", "left").withColumn("used", used)
    skus, messages = plan_limit(F.col("plan"), 0), plan_limit(F.col("plan"), 1)
    decision = (F.when(expired, "trial_ended").when(F.col("used") >= messages, "messages_used_up").otherwise("ok"))
    return df.select("user_id", "plan", F.col("used").cast("int").alias("used"), messages.alias("message_limit"),
                     decision.alias("message_decision"),
                     F.when(F.coalesce("sku_count", F.lit(0)) > skus, "over_sku_limit").otherwise("ok").alias("upload_decision"))


def trial_state(profiles: DataFrame, now: Column) -> DataFrame:
    paid = F.col("plan").isin(PAID_PLANS)
    seconds = F.timestamp_diff("SECOND", now, F.col("trial_ends")).cast("double")
    days = F.greatest(F.lit(0), F.ceil(seconds / 86400.0)).cast("double")
    return profiles.select(
        "user_id", "plan", paid.alias("is_paid"),
        F.when(~paid & F.col("trial_ends").isNotNull(), days).alias("days_left"),
        F.coalesce(~paid & (F.col("trial_ends") <= now), F.lit(False)).alias("expired"))


def retention_valid(hours: Column) -> Column:
    return F.coalesce(hours.between(1, MAX_RETENTION_HOURS), F.lit(False))


def retention_lookup(uploads: DataFrame, companies: DataFrame) -> DataFrame:
    """Hours each upload is kept and when it expires."""
    hours = companies.select("company_id", "retention_hours")
    out = uploads.join(hours, "company_id", "left").withColumn(
        "retention_hours", F.coalesce("retention_hours", F.lit(DEFAULT_RETENTION_HOURS)))
    return out.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.col("retention_hours")))


def expire_uploads(uploads: DataFrame, now: Column) -> DataFrame:
    """Soft delete: stamp rows past their deadline, leave the analysis alone."""
    due = (F.col("expires_at") < now) & F.col("deleted_at").isNull()
    return uploads.withColumn("newly_expired", F.coalesce(due, F.lit(False))).withColumn(
        "deleted_at", F.when(due, now).otherwise(F.col("deleted_at")))


def private_mode_lookup(profiles: DataFrame, companies: DataFrame) -> DataFrame:
    flags = companies.select("company_id", "private_processing_mode")
    return profiles.join(flags, "company_id", "left").select(
        "user_id", F.coalesce("private_processing_mode", F.lit(False)).alias("private_mode"))


def new_company_id(user_id: Column) -> Column:
    """Id of the company made for a user without one; a hash, so reruns agree."""
    return F.substring(F.sha2(user_id, 256), 1, 32)


def backfill_company(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies to create, and all profiles with their company filled in."""
    alone = F.col("company_id").isNull()
    created = profiles.where(alone).select(
        new_company_id(F.col("user_id")).alias("company_id"), F.split_part("email", F.lit("@"), F.lit(2)).alias("name"),
        F.coalesce("plan", F.lit("trial")).alias("plan"))
    linked = profiles.withColumn("company_id", F.when(alone, new_company_id(F.col("user_id"))).otherwise(F.col("company_id")))
    return created, linked


def backfill_from(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Fill a missing company of ``rows`` from the row of ``source`` it points to."""
    found = source.select(key, F.col("company_id").alias("_company"))
    return rows.join(found, key, "left").withColumn("company_id", F.coalesce("company_id", "_company")).drop("_company")


def company_users(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("company_id").isNotNull()).select("company_id", "user_id", "email", "full_name", "role", "is_active")


def client_ip(forwarded: Column, proxy: Column, real: Column, remote: Column) -> Column:
    """First address of the first filled header, else the peer, else ``unknown``."""
    header = F.coalesce(*[F.nullif(h, F.lit("")) for h in (forwarded, proxy, real)])
    first = F.trim(F.split_part(header, F.lit(","), F.lit(1)))
    return F.coalesce(first, F.nullif(remote, F.lit("")), F.lit("unknown"))


def audit_records(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid audit rows, and rows whose status is outside the allowed set. Values are kept whole."""
    shaped = events.fillna({"user_agent": "", "metadata": "{}"})
    valid = F.coalesce(F.col("status").isin(AUDIT_STATUSES), F.lit(False))
    return shaped.where(valid), shaped.where(~valid)


BLOCKED = ["FAILURE", "BLOCKED"]


def recent_audit(logs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` records per company."""
    order = [F.desc("timestamp"), F.desc("log_id")]
    return top_per(logs.where(F.col("company_id").isNotNull()), ["company_id"], order, limit)


def audit_security_events(logs: DataFrame) -> DataFrame:
    return recent_audit(logs.where(F.col("status").isin(BLOCKED)), SECURITY_EVENTS_KEPT)


def audit_stats(logs: DataFrame) -> DataFrame:
    """Events per company and per company and action (action NULL = company total).

    Company totals are summed from the counts per action, so raw records are read and
    shuffled once and never expanded.
    """
    per_action = logs.where(F.col("company_id").isNotNull()).groupBy("company_id", "action").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin(BLOCKED)).alias("b"))
    return per_action.groupingSets([["company_id"], ["company_id", "action"]], "company_id", "action").agg(
        F.sum("n").alias("total_events"), F.sum("b").alias("blocked_events"))


def security_posture(companies: DataFrame, logs: DataFrame) -> DataFrame:
    totals = audit_stats(logs).where(F.col("action").isNull()).drop("action")
    return companies.join(totals, "company_id", "left").select(
        "company_id", F.coalesce("private_processing_mode", F.lit(False)).alias("private_mode"),
        F.coalesce("retention_hours", F.lit(DEFAULT_RETENTION_HOURS)).alias("retention_hours"),
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("blocked_events", F.lit(0)).alias("blocked_events"))


def reset_monthly_quota(profiles: DataFrame, now: Column) -> DataFrame:
    month = F.date_trunc("month", now)
    due = F.coalesce(F.col("ai_messages_reset") < month, F.lit(False))
    return profiles.withColumn("ai_messages_used", F.when(due, F.lit(0)).otherwise(F.col("ai_messages_used"))).withColumn(
        "ai_messages_reset", F.when(due, month).otherwise(F.col("ai_messages_reset")))


def ai_usage_count(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """User messages per user and month against the plan's limit."""
    used = messages.where(F.col("role") == "user").groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.count("*").alias("used"))
    limit = plan_limit(F.coalesce("plan", F.lit("trial")), 1)
    return used.join(profiles.select("user_id", "plan"), "user_id", "left").select(
        "user_id", F.date_format("month", "yyyy-MM").alias("month"), "used", limit.alias("message_limit"),
        (F.col("used") >= limit).alias("exhausted"))


def profile_seed(signups: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Profiles after a batch of sign-ins: new ones get a trial, known ones keep their plan."""
    name = F.coalesce(F.get_json_object("metadata", "$.full_name"), F.split_part("email", F.lit("@"), F.lit(1)))
    seen = signups.groupBy("user_id").agg(F.max_by(F.struct("email", name.alias("full_name")), "ts").alias("s"))
    fresh = seen.join(profiles, "user_id", "left_anti").select(
        "user_id", "s.email", "s.full_name", F.lit("trial").alias("plan"),
        (now + F.make_dt_interval(days=F.lit(TRIAL_DAYS))).alias("trial_ends"))
    kept = profiles.join(seen, "user_id", "left").select(
        "user_id", F.coalesce("s.email", profiles["email"]).alias("email"),
        F.coalesce("s.full_name", profiles["full_name"]).alias("full_name"), "plan", "trial_ends")
    return kept.unionByName(fresh)


def settings_apply(companies: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Companies after the latest valid change per setting, and one audit row per change.

    ``changes``: company_id, ts, change_id, setting (retention_hours | private_processing_mode), value.
    """
    hours = F.col("value").try_cast("int")
    ok = ((F.col("setting") == "retention_hours") & retention_valid(hours)) | (
        (F.col("setting") == "private_processing_mode") & F.col("value").isin("true", "false"))
    valid = changes.where(ok)
    last = lambda s: F.max_by("value", F.when(F.col("setting") == s, F.struct("ts", "change_id")))
    latest = valid.groupBy("company_id").agg(
        last("retention_hours").alias("new_hours"), last("private_processing_mode").alias("new_mode"))
    joined = companies.join(latest, "company_id", "left")
    after = joined.select(
        "company_id", "name",
        F.coalesce(F.col("new_hours").cast("int"), F.col("retention_hours")).alias("retention_hours"),
        F.coalesce(F.col("new_mode").cast("boolean"), F.col("private_processing_mode")).alias("private_processing_mode"),
        F.when(F.col("new_hours").isNotNull() | F.col("new_mode").isNotNull(), now).alias("updated_at"))
    trail = valid.join(companies, "company_id").select(
        "company_id", "change_id", "ts", F.lit("SETTINGS_CHANGED").alias("action"), "setting",
        F.when(F.col("setting") == "retention_hours", F.col("retention_hours").cast("string"))
        .otherwise(F.col("private_processing_mode").cast("string")).alias("old_value"), F.col("value").alias("new_value"))
    return after, trail


def role_changes(profiles: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles after the latest valid role change, and one audit row per changed profile."""
    allowed = [r for r in ROLE_LEVELS if r != "Admin"]
    latest = changes.where(F.col("role").isin(allowed)).groupBy("user_id").agg(
        F.max_by("role", F.struct("ts", "change_id")).alias("to_role"))
    after = profiles.join(latest, "user_id", "left").withColumn("from_role", F.col("role")).withColumn(
        "role", F.coalesce("to_role", "role"))
    trail = after.where(F.col("to_role").isNotNull()).select("user_id", F.lit("ROLE_CHANGE").alias("action"), "from_role", "to_role")
    return after.drop("from_role", "to_role"), trail


# Column names hidden from outside services, and those replaced by an alias.
HIDDEN_FIELDS = [
    "supplier", "vendor", "brand_owner", "manufacturer", "supplier_code", "vendor_id", "vendor_ref", "vendor_name",
    "internal_notes", "comments", "buyer_notes", "merchandiser_notes", "contact", "contract_price",
    "cost_price_negotiated", "factory", "country_of_origin", "ethical_audit_ref",
]
ALIASED_FIELDS = ["supplier", "vendor", "vendor_name", "brand_owner"]


def alias_of(value: Column, prefix: str = "VENDOR") -> Column:
    """Stable pseudonym; empty values stay missing."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""),
                  F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(text, 256), 1, 8))))


def bare_name(column: str) -> str:
    return re.sub("[_ ]", "", column.lower())


#: What happens to a column whose bare name contains one of these.
TREATMENTS = {bare_name(f): "alias" if f in ALIASED_FIELDS else "drop" for f in HIDDEN_FIELDS}


def field_treatment(column: str) -> str:
    """``alias``, ``drop`` or ``keep``; one name that asks for an alias is enough."""
    matched = {how for name, how in TREATMENTS.items() if name in bare_name(column)}
    return next((how for how in ("alias", "drop") if how in matched), "keep")


def mask_standard(items: DataFrame) -> DataFrame:
    """Item table with sensitive columns aliased or left out; decided from names alone."""
    shown = {"keep": lambda c: F.col(f"`{c}`"), "alias": lambda c: alias_of(F.col(f"`{c}`")).alias(c)}
    return items.select(*[shown[how](c) for c in items.columns if (how := field_treatment(c)) in shown])


def mask_private(kpis: DataFrame, categories: DataFrame, reorder: DataFrame, markdown: DataFrame) -> DataFrame:
    """Aggregates only: all KPIs of a dataset, how many categories it has and alerts it lists,
    and one row per category without its name. No row names a product, supplier or SKU."""
    listed = lambda df, name: df.groupBy("dataset_id").agg(F.count("*").alias(name))
    counts = [listed(categories, "category_count"), listed(reorder, "listed_reorders"), listed(markdown, "listed_markdowns")]
    base = kpis.drop("role_mask")
    for c in counts:
        base = base.join(c, "dataset_id", "left")
    base = base.fillna(0, ["category_count", "listed_reorders", "listed_markdowns"])
    cats = categories.select("dataset_id", "health", F.col("revenue").alias("category_revenue"),
                             F.col("avg_sell_through").alias("category_sell_through"),
                             F.col("avg_margin_pct").alias("category_margin_pct"), F.col("sku_count").alias("category_skus"))
    return base.join(cats, "dataset_id", "left")


def private_datasets(datasets: DataFrame, companies: DataFrame) -> DataFrame:
    """Datasets of the companies that chose private processing."""
    private = companies.where(F.coalesce("private_processing_mode", F.lit(False))).select("company_id")
    return datasets.join(private, "company_id", "left_semi").select("dataset_id")


def outgoing_items(items: DataFrame, private: DataFrame) -> DataFrame:
    """Rows of an item table that may leave: none of a private dataset, the others masked."""
    return mask_standard(items.join(private, "dataset_id", "left_anti"))
