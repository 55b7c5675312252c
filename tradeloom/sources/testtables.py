"""Adapter from the star-schema test tables to the schemas of this library.

Only the tests, the bench and the registered queries use it; the definitions are those
of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.functions.names import literal_map
from tradeloom.operators.governance import PERMISSIONS, ROLE_LEVELS, literal_table
from tradeloom.sources.roles import ALL_ROLES

AS_OF = "2024-01-15 00:00:00"


# Known schemas spare a job per table that would only read a footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Split a table over the cores when its files have fewer splits than there are cores.

    A file with one row group is one task however large the job; tables of many files come
    in enough splits and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def trading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    li = spread(t("lineitem"), "l_orderkey")
    # What depends on a part alone is computed before the join with the lines, and orders, a quarter of
    # the lines and narrow, find their segment first: the lines are not moved by customer.
    part = t("part").withColumns({"b": F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), "retail": F.col("p_retailprice").cast("decimal(12,2)")})
    orders = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_mktsegment")
    )
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supp = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    # Parts are joined last and by the SKU itself: lines moved for that join already lie as the SKU roll-up groups them.
    sku = F.col("l_partkey").cast("string")
    joined = (
        li.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part.hint("shuffle_hash"), sku == F.col("p_partkey").cast("string"))
    )
    b, retail = F.col("b"), F.col("retail")
    margin = F.lit(20) + F.pmod(b * 7, F.lit(45)) + F.pmod(F.col("l_suppkey"), F.lit(10))
    share = (margin / 100).cast("decimal(4,2)")
    revenue = (F.col("l_extendedprice").cast("decimal(12,2)")
               * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return joined.select(
        F.concat_ws(":", "c_mktsegment", F.year("l_shipdate").cast("string")).alias("dataset_id"),
        F.col("c_mktsegment").alias("user_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("row_id"),
        sku.alias("sku"),
        F.col("l_quantity").cast("decimal(18,2)").alias("units"),
        revenue.alias("revenue"),
        F.pmod(F.col("l_orderkey") * 7 + F.col("l_partkey") * 3, F.lit(60)).cast("double").alias("stock"),
        (retail * (1 - share)).cast("decimal(18,4)").alias("cost"),
        margin.cast("double").alias("margin_pct"),
        (revenue * share).cast("decimal(18,6)").alias("margin_value"),
        retail.cast("decimal(18,2)").alias("retail"),
        F.least(F.lit(100.0), (F.pmod(F.col("l_orderkey") * 13 + F.col("l_partkey") * 5, F.lit(96)) * b).cast("double")
                / F.lit(18.0)).alias("sell_through"),
        (F.pmod(F.col("l_orderkey") + F.col("l_partkey") * 11, F.lit(200)).cast("double") / F.lit(10.0)).alias("cover_weeks"),
        (F.col("p_size") * 10).cast("double").alias("buy_qty"),
        F.when(F.col("l_discount") == 0, revenue).otherwise(F.lit(0).cast("decimal(18,4)")).alias("full_price_sales"),
        F.col("p_brand").alias("category"),
        F.col("r_name").alias("channel"),
        F.date_trunc("week", "l_shipdate").cast("date").cast("string").alias("week"),
        F.col("p_name").alias("name"),
        F.col("s_name").alias("brand"),
        F.lit(ALL_ROLES).alias("role_mask"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    hours = F.pmod(F.col("n_nationkey"), F.lit(4)) * 24
    return n.select(
        F.col("n_nationkey").cast("string").alias("company_id"),
        F.col("n_name").alias("name"),
        F.lit("trial").alias("plan"),
        F.when(hours != 0, hours).cast("int").alias("retention_hours"),
        (F.pmod(F.col("n_nationkey"), F.lit(3)) == 0).alias("private_processing_mode"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    plans = F.array(*[F.lit(p) for p in ("trial", "starter", "growth", "studio", "legacy")])
    roles = F.array(*[F.lit(r) for r in ROLE_LEVELS])
    return c.select(
        key.cast("string").alias("user_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"),
                 F.lit(".example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
        F.element_at(plans, (F.pmod(key, F.lit(5)) + 1).cast("int")).alias("plan"),
        F.date_add(as_of(), (F.pmod(key, F.lit(40)) - 20).cast("int")).cast("timestamp_ntz").alias("trial_ends"),
        F.pmod(key, F.lit(70)).cast("int").alias("ai_messages_used"),
        F.add_months(F.lit("2023-12-01").cast("date"), F.pmod(key, F.lit(2)).cast("int")).cast("timestamp_ntz").alias("ai_messages_reset"),
        F.element_at(roles, (F.pmod(F.col("c_nationkey"), F.lit(5)) + 1).cast("int")).alias("role"),
        F.when(F.pmod(key, F.lit(10)) != 0, F.col("c_nationkey").cast("string")).alias("company_id"),
        (F.pmod(key, F.lit(13)) != 0).alias("is_active"),
    )


def datasets(rows: DataFrame) -> DataFrame:
    """One row per uploaded dataset found in lines, SKUs or KPIs."""
    base = rows.groupBy("dataset_id").agg(F.max("role_mask").alias("role_mask")).withColumn(
        "user_id", F.element_at(F.split("dataset_id", ":"), 1))
    y = F.element_at(F.split("dataset_id", ":"), 2).cast("int")
    names = F.array(*[F.lit(n) for n in ("buy_plan_", "clearance_", "supplier_", "stock_", "range_", "weekly_")])
    exts = F.array(*[F.lit(n) for n in (".csv", ".xlsx", ".ods", ".tsv", ".txt", ".numbers")])
    slot = (F.pmod(y, F.lit(6)) + 1).cast("int")
    segments = {"AUTOMOBILE": "0", "BUILDING": "1", "FURNITURE": "2", "HOUSEHOLD": "3", "MACHINERY": "4"}
    company = F.coalesce(F.try_element_at(literal_map(segments), F.col("user_id")), F.lit("5"))
    created = F.make_date(y, F.lit(12), F.lit(31)).cast("timestamp_ntz")
    return base.select(
        "dataset_id", "user_id", company.alias("company_id"),
        F.concat(F.element_at(names, slot), y.cast("string"), F.element_at(exts, slot)).alias("filename"),
        created.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        (y * 1000).cast("bigint").alias("file_size"),
        F.struct(
            F.when(F.pmod(y, F.lit(3)) == 0, F.concat(F.lit("Season "), y.cast("string"))).alias("display_name"),
            F.when(F.pmod(y, F.lit(2)) == 0, F.array(F.lit("season"), F.col("user_id"), F.lit("key")))
            .otherwise(F.array(F.lit("season"), F.col("user_id"))).alias("tags"),
            (F.pmod(y, F.lit(7)) == 0).alias("archived"),
            (F.pmod(y, F.lit(5)) == 1).alias("trashed"),
            F.lit(None).cast("string").alias("dataset_type"),
            F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("analysed_at"),
        ).alias("workspace"),
        "role_mask",
    )


def pairs(uploads: DataFrame) -> DataFrame:
    """Each user's dataset with that of the year after."""
    d = uploads.select("user_id", "dataset_id", F.year("created_at").alias("y"))
    a = d.select("user_id", F.col("dataset_id").alias("a"), "y")
    b = d.select("user_id", F.col("dataset_id").alias("b"), (F.col("y") - 1).alias("y"))
    return a.join(b, ["user_id", "y"]).select("user_id", "a", "b")


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_view(table(spark, sf_dir, "events"))


def audit_view(events: DataFrame) -> DataFrame:
    """events seen as audit records (batch or stream)."""
    actions = {"error": "AUTH_FAILED", "click": "DATA_EXPORT", "view": "AI_QUERY",
               "signup": "USER_LOGIN", "purchase": "FILE_UPLOAD"}
    status = F.when(F.col("event_type") == "error",
                    F.when(F.pmod("event_id", F.lit(2)) == 0, "FAILURE").otherwise("BLOCKED")).otherwise("SUCCESS")
    return events.select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.pmod("user_id", F.lit(25)).cast("string").alias("company_id"),
        F.try_element_at(literal_map(actions), F.col("event_type")).alias("action"),
        status.alias("status"), F.col("props").alias("metadata"),
    )


def auth_attempts(events: DataFrame) -> DataFrame:
    """error and signup events seen as failed and successful sign-ins (batch or stream)."""
    return events.where(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("account"), "ts", F.col("event_id").alias("attempt_id"),
        (F.col("event_type") == "signup").alias("success"))


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("request_id"))


def billing_events(events: DataFrame) -> DataFrame:
    """purchase, click and error events seen as billing webhooks; every tenth arrives twice."""
    types = {"purchase": "checkout.session.completed", "click": "customer.subscription.updated",
             "error": "customer.subscription.deleted"}
    prices = F.array(*[F.lit(p) for p in ("price_starter", "price_growth", "price_studio", "price_other")])
    copies = F.when(F.pmod("event_id", F.lit(10)) == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        events.where(F.col("event_type").isin(list(types)))
        .select(
            F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
            F.try_element_at(literal_map(types), F.col("event_type")).alias("type"),
            F.col("ts"),
            F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer"),
            F.element_at(prices, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("price_id"),
            F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("user_id").cast("string")).alias("reference_id"),
            F.concat(F.lit("User."), F.col("user_id").cast("string"), F.lit("@Example.com")).alias("email"),
            F.when(F.pmod("event_id", F.lit(7)) == 0, "canceled").otherwise("active").alias("status"),
            F.explode(copies).alias("delivery"),
        )
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("u"), F.pmod("conv_id", F.lit(20)).cast("string")).alias("user_id"),
        F.col("conv_id").cast("string").alias("dataset_id"),
        F.col("turn"), "role", F.col("text").alias("content"))


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages and documents seen as uploaded files."""
    exts = F.array(*[F.lit(e) for e in (".csv", ".txt", ".exe", ".xlsx", "")])
    part = lambda df, key, text, stem: spread(df, key).select(
        F.concat(F.lit(stem), F.col(key).cast("string"),
                 F.element_at(exts, (F.pmod(key, F.lit(5)) + 1).cast("int"))).alias("filename"),
        F.col(text).cast("binary").alias("content"))
    return part(table(spark, sf_dir, "pages"), "page_id", "html", "page_").unionByName(
        part(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_"))


def permissions(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["action", "min_role"], sorted(PERMISSIONS.items()))
