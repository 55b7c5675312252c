"""Dataset catalogue: cards, filters, counts, tags, updates, latest dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.functions.names import dataset_type, file_type
from tradeloom.functions.numbers import whole
from tradeloom.operators.alerts import top_per
from tradeloom.operators.health import health_total

DS = "dataset_id"
# Rows of a user's catalogue, of the upload list, and limits of an update.
RECENT_UPLOADS, NAME_LENGTH, TAG_LENGTH, TAGS_SHOWN = 20, 120, 32, 12

NEWEST_FIRST = ["created_at", DS]


def newest() -> list[Column]:
    return [F.desc(c) for c in NEWEST_FIRST]


def scan_uploads(uploads: DataFrame, user: str | None = None, limit: int | None = None) -> DataFrame:
    """Listing of uploads newest first, optionally of one user and cut."""
    out = uploads.select(DS, "user_id", "filename", "created_at", "file_size")
    if user is not None:
        out = out.where(F.col("user_id") == user)
    return out.orderBy(*newest()).limit(limit) if limit else out


def recent_uploads(uploads: DataFrame, k: int = RECENT_UPLOADS) -> DataFrame:
    return top_per(uploads, ["user_id"], newest(), k)


def latest_dataset(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Dataset each request resolves to: the named one if owned, else the user's newest.

    ``requests``: user_id, company_id (NULL = no company filter), dataset_id (NULL = none named).
    The newest upload is one aggregate per user and per (user, company), so no window over
    a user's uploads is needed.
    """
    key = F.struct(*NEWEST_FIRST)
    per_user = uploads.groupBy("user_id").agg(F.max_by(DS, key).alias("newest"))
    per_company = uploads.groupBy("user_id", "company_id").agg(F.max_by(DS, key).alias("newest_in_company"))
    owned = uploads.select("user_id", F.col("company_id").alias("owner_company"), F.col(DS).alias("named")).withColumn("owned", F.col("named"))
    out = (
        requests.withColumnRenamed(DS, "named")
        .join(owned, ["user_id", "named"], "left")
        .join(per_user, "user_id", "left")
        .join(per_company, ["user_id", "company_id"], "left")
    )
    in_scope = F.col("company_id").isNull() | (F.col("company_id") == F.col("owner_company"))
    fallback = F.when(F.col("company_id").isNull(), F.col("newest")).otherwise(F.col("newest_in_company"))
    return out.select("user_id", "company_id", "named", F.coalesce(F.when(in_scope, F.col("owned")), fallback).alias(DS))


def switch_check(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Requests that name a dataset of the same user."""
    return requests.join(uploads.select("user_id", DS), ["user_id", DS], "left_semi")


def stock_value_estimate() -> Column:
    """Stock at cost, estimated from revenue."""
    return whole(F.col("total_revenue") * 0.5 / 12)


def catalogue(datasets: DataFrame, rows: int | None = None) -> DataFrame:
    """The datasets the workspace looks at: all, or the newest ``rows`` of each user."""
    return datasets if rows is None else top_per(datasets, ["user_id"], newest(), rows, "_n").drop("_n")


def dataset_cards(datasets: DataFrame, kpis: DataFrame) -> DataFrame:
    """Card of every dataset: names, dates, kind, counts, headline KPIs, stock value, health."""
    ws = lambda f: F.col(f"workspace.{f}")
    none = F.array().cast("array<string>")
    name = F.coalesce("filename", F.lit("Untitled"))
    tags = F.coalesce(ws("tags"), none)
    figures = kpis.drop("role_mask")
    joined = datasets.join(figures, DS, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        DS, "user_id", "company_id", name.alias("filename"),
        F.coalesce(F.nullif(ws("display_name"), F.lit("")), name).alias("display_name"),
        F.col("created_at").alias("upload_date"), F.coalesce(ws("analysed_at"), F.col("created_at")).alias("analysed_date"),
        file_type(name).alias("file_type"), F.coalesce(ws("dataset_type"), dataset_type(name, tags)).alias("dataset_type"),
        F.coalesce("sku_count", F.lit(0)).alias("record_count"), F.coalesce("file_size", F.lit(0)).alias("file_size"),
        F.coalesce(ws("status"), F.lit("Analysed")).alias("status"), tags.alias("tags"),
        F.coalesce(ws("archived"), F.lit(False)).alias("archived"), F.coalesce(ws("trashed"), F.lit(False)).alias("trashed"),
        zero("total_revenue").alias("revenue"), zero("avg_margin_pct").alias("margin"), zero("avg_sell_through").alias("sell_through"),
        F.coalesce(stock_value_estimate(), F.lit(0)).alias("stock_value"),
        F.coalesce(F.when(F.col("total_revenue").isNotNull(), health_total()), F.lit(0)).alias("health_score"),
    )


def view_condition(view: str) -> Column:
    archived, trashed = F.col("archived"), F.col("trashed")
    return {"active": ~archived & ~trashed, "archived": archived & ~trashed, "trash": trashed, "all": ~trashed}[view]


def workspace_filter(cards: DataFrame, view: str = "active", query: str = "", tag: str = "") -> DataFrame:
    """Cards of a view that match a text in names or tags and carry a tag."""
    out = cards.where(view_condition(view))
    query, tag = query.strip().lower(), tag.strip().lower()
    if query:
        named = F.contains(F.lower(F.concat_ws(" ", "display_name", "filename")), F.lit(query))
        out = out.where(named | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(query))))
    if tag:
        out = out.where(F.exists("tags", lambda t: F.lower(t) == tag))
    return out


def workspace_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("user_id").agg(
        *[F.count_if(view_condition(v)).alias(v) for v in ("active", "archived", "trash")], F.count("*").alias("total"))


def tag_cloud(cards: DataFrame) -> DataFrame:
    """Tags over datasets that are not in the trash."""
    live = cards.where(~F.col("trashed")).select("user_id", F.explode("tags").alias("tag"))
    return live.groupBy("user_id", "tag").agg(F.count("*").alias("datasets"))


def clean_tags(tags: Column) -> Column:
    """Trimmed and non-blank; all of them, whole."""
    return F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")


def over_limits(display_name: Column, tags: Column) -> Column:
    """Which limits of the workspace's forms a change exceeds; it is applied whole all the same."""
    return F.array_compact(F.array(
        F.when(F.char_length(F.trim(display_name)) > NAME_LENGTH, "name_too_long"), F.when(F.size(clean_tags(tags)) > TAGS_SHOWN, "too_many_tags"),
        F.when(F.exists(clean_tags(tags), lambda t: F.char_length(t) > TAG_LENGTH), "tag_too_long")))


def workspace_update(datasets: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Catalogue after a batch of changes; the last change per dataset and field wins.

    ``changes``: dataset_id, user_id, ts, display_name, tags, archived, trashed (NULL = untouched).
    Only changes by the owner apply.
    """
    name = F.nullif(F.trim(F.col("display_name")), F.lit(""))
    wanted = changes.select(DS, "user_id", "ts", name.alias("display_name"), clean_tags(F.col("tags")).alias("tags"), "archived", "trashed")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"new_{c}")
    fields = ("display_name", "tags", "archived", "trashed")
    last = wanted.groupBy(DS, "user_id").agg(*[latest(c) for c in fields], F.lit(True).alias("touched"))
    joined = datasets.join(last, [DS, "user_id"], "left")
    ws = F.col("workspace")
    for c in fields:
        ws = ws.withField(c, F.coalesce(F.col(f"new_{c}"), F.col(f"workspace.{c}")))
    out = joined.withColumn("workspace", ws).withColumn("updated_at", F.when(F.col("touched"), now))
    return out.drop("touched", *[f"new_{c}" for c in fields])


def chat_context(messages: DataFrame, k: int = 20, latest: bool = False) -> DataFrame:
    """k messages per user and dataset: the first ones, or the last ones with ``latest``."""
    order = [F.desc("turn") if latest else F.asc("turn")]
    return top_per(messages, ["user_id", DS], order, k, "position")
