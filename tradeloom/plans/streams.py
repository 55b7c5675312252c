"""Registered queries: streams with their batch twins, and ingestion from written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradeloom.operators import rollup
from tradeloom.plans.registry import CTES, register
from tradeloom.sources import delimited, testtables as tt
from tradeloom.staging import scratch, staged
from tradeloom.streaming import billing, limits, lockout

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
stamp_sql = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
TWO_DAYS = 2 * 24 * 3600


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(tt.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and return what it appended."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = scratch(spark, name)
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# ---- billing -------------------------------------------------------------------------

CTES["first_billing"] = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, delivery) AS r FROM billing) WHERE r = 1"
BILL = "id, type, customer, price_id, reference_id, email, status"


@register("billing_dedup", f"SELECT {BILL} FROM first_billing WHERE NOT (id LIKE '%5')")
def _(spark, d):
    """Ids ending in 5 were processed by an earlier run."""
    events = tt.billing_events(tt.table(spark, d, "events"))
    done = tt.table(spark, d, "events").select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id")).where(F.col("id").endswith("5"))
    return billing.billing_dedup(events, done).select(*BILL.split(", "))


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """Billing events as a stream of files, a batch each: what arrives twice does so in another
    batch, and every third event arrives long after newer ones."""
    path = scratch(spark, "deliveries")
    events = tt.billing_events(tt.table(spark, d, "events"))
    part = F.when(F.col("delivery") > 1, 2).otherwise(F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, 1).otherwise(0))
    for i in range(3):
        events.where(part == i).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run_batches(stream: DataFrame, step, folder: str) -> None:
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@register("billing_dedup_stream", f"SELECT {BILL} FROM first_billing")
def _(spark, d):
    return drained(billing.billing_dedup_stream(delivered(spark, d)), "dedup").select(*BILL.split(", "))


@register("billing_from_messages", f"SELECT id, type, customer, status, cast(epoch_us(ts) // 1000000 as bigint) AS created FROM first_billing")
def _(spark, d):
    """The same events as JSON messages of a queue."""
    e = billing.billing_dedup(tt.billing_events(tt.table(spark, d, "events")))
    obj = F.struct("customer", "status")
    body = F.to_json(F.struct("id", "type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"), F.struct(obj.alias("object")).alias("data")))
    rows = billing.billing_from_messages(e.select(body.cast("binary").alias("value")))
    return rows.select("id", "type", "customer", "status", F.unix_seconds("ts").alias("created"))


PLAN = "case price_id when 'price_starter' then 'starter' when 'price_growth' then 'growth' when 'price_studio' then 'studio' else 'starter' end"
# Every fifth user has bought in an earlier run: a stored customer and no checkout now.
CTES["fold_profiles"] = """SELECT DISTINCT cast(user_id as varchar) AS user_id, 'user.' || user_id || '@example.com' AS email, case when user_id % 5 = 0 then 'growth' else 'trial' end AS plan,
  case when user_id % 5 = 0 then 'cus_' || user_id end AS customer FROM events"""
CTES["fold_billing"] = "SELECT * FROM first_billing WHERE type <> 'checkout.session.completed' OR cast(substr(customer, 5) as bigint) % 5 <> 0"
CTES["bought"] = f"""SELECT coalesce(reference_id, p.user_id) AS user_id, id, ts, b.customer, {PLAN} AS plan FROM fold_billing b LEFT JOIN fold_profiles p ON p.email = lower(b.email)
  WHERE type = 'checkout.session.completed'"""
CTES["subscribed"] = f"""SELECT customer, ts, id, case when type = 'customer.subscription.deleted' or status = 'canceled' then 'trial' else {PLAN} end AS plan
  FROM fold_billing WHERE type <> 'checkout.session.completed'"""


FOLDED = """
SELECT p.user_id, case when c.user_id IS NULL then p.customer else c.customer end AS customer,
  coalesce((SELECT arg_max(s.plan, s.ts) FROM subscribed s WHERE s.customer = case when c.user_id IS NULL then p.customer else c.customer end AND (c.ts IS NULL OR s.ts > c.ts)), c.plan, p.plan) AS plan
FROM fold_profiles p LEFT JOIN (SELECT user_id, arg_max(customer, ts) AS customer, arg_max(plan, ts) AS plan, max(ts) AS ts FROM bought GROUP BY 1) c ON c.user_id = p.user_id"""


def fold_profiles(spark: SparkSession, d: str) -> DataFrame:
    known, name = F.col("user_id") % 5 == 0, F.col("user_id").cast("string")
    return tt.table(spark, d, "events").select("user_id").distinct().select(
        name.alias("user_id"), F.concat(F.lit("user."), name, F.lit("@example.com")).alias("email"), F.when(known, "growth").otherwise("trial").alias("plan"),
        F.when(known, F.concat(F.lit("cus_"), name)).alias("customer"))


def without_known_checkouts(events: DataFrame) -> DataFrame:
    return events.where((F.col("type") != billing.CHECKOUT) | (F.substring("customer", 5, 20).cast("bigint") % 5 != 0))


@register("plan_fold", FOLDED)
def _(spark, d):
    events = billing.billing_dedup(tt.billing_events(tt.table(spark, d, "events")))
    return billing.plan_fold(without_known_checkouts(events), fold_profiles(spark, d))


@register("plan_fold_stream", FOLDED)
def _(spark, d):
    """The same over batches that arrive late, out of order and twice."""
    folder = scratch(spark, "plans")
    fold = billing.PlanFold(folder, staged(fold_profiles(spark, d), "profiles"))
    run_batches(without_known_checkouts(delivered(spark, d)), fold, folder)
    return fold.plans(spark)


@register("scan_billing_events", "SELECT id, type, customer, price_id, reference_id, email, status, cast(epoch_us(ts) // 1000000 as bigint) AS created FROM billing")
def _(spark, d):
    """Events written as webhook JSON lines, then read back as a stream."""
    e = tt.billing_events(tt.table(spark, d, "events"))
    obj = F.struct(F.col("id").alias("id"), "customer", F.col("reference_id").alias("client_reference_id"), "status",
                   F.struct("email").alias("customer_details"), F.when(F.col("type") == billing.CHECKOUT, F.col("price_id")).alias("price_id"),
                   F.struct(F.array(F.struct(F.struct(F.col("price_id").alias("id")).alias("price"))).alias("data")).alias("items"))
    path = scratch(spark, "webhooks")
    e.select("id", "type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"), F.struct(obj.alias("object")).alias("data")).write.json(path)
    rows = drained(billing.scan_billing_events(spark, path), "webhook-rows")
    return rows.select("id", "type", "customer", "price_id", "reference_id", "email", "status", F.unix_seconds("ts").alias("created"))


# ---- lockout -------------------------------------------------------------------------

LOCK_SQL = f"""
SELECT account, attempt_id, status, fails, locked, case when status = 'SUCCESS' then 0 else least(0.5 * pow(2, fails - 1), 5) end AS delay FROM (
WITH RECURSIVE a AS (SELECT account, epoch_us(ts) AS now, attempt_id, success, row_number() OVER (PARTITION BY account ORDER BY ts, attempt_id) AS rn FROM attempts),
w AS (
  SELECT DISTINCT account, cast(0 as bigint) AS rn, cast(0 as bigint) AS fails, cast(0 as bigint) AS last, cast(0 as bigint) AS until, cast(-1 as bigint) AS attempt_id, '' AS status, false AS locked FROM attempts
  UNION ALL
  SELECT account, rn, case when blocked then fails when success then 0 else live + 1 end, case when blocked then last when success then 0 else now end,
    case when blocked then until when success or live + 1 < 5 then 0 else now + {TWO_DAYS * 1000000} end, attempt_id,
    case when blocked then 'BLOCKED' when success then 'SUCCESS' else 'FAILURE' end, not blocked and not success and live + 1 >= 5
  FROM (SELECT w.account, a.rn, w.fails, w.last, w.until, a.now, a.attempt_id, a.success, w.fails > 0 and w.until > a.now AS blocked,
      case when w.fails > 0 and a.now - w.last > {TWO_DAYS * 1000000} then 0 else w.fails end AS live
    FROM w JOIN a ON a.account = w.account AND a.rn = w.rn + 1))
SELECT * FROM w WHERE rn > 0)"""
LOCK_COLS = ["account", "attempt_id", "status", "cast(fails as bigint) AS fails", "locked", "delay"]


@register("login_lockout", LOCK_SQL)
def _(spark, d):
    return lockout.lockout_batch(tt.auth_attempts(tt.table(spark, d, "events")), TWO_DAYS).selectExpr(*LOCK_COLS)


@register("login_lockout_stream", f"""SELECT * FROM ({LOCK_SQL}) WHERE attempt_id IN (SELECT attempt_id FROM attempts WHERE ts < (SELECT max(ts) - to_minutes(10) FROM attempts))""")
def _(spark, d):
    return drained(lockout.lockout_stream(tt.auth_attempts(events_stream(spark, d)), TWO_DAYS), "lockout").selectExpr(*LOCK_COLS)


EPISODES = f"""
SELECT account, {stamp_sql('min(ts)')} AS started, {stamp_sql('max(ts)')} AS ended, count(*) AS failures FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY ts, attempt_id) AS episode FROM (
    SELECT *, case when epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account ORDER BY ts, attempt_id)) <= {TWO_DAYS * 1000000} then 0 else 1 end AS fresh FROM attempts WHERE NOT success))
GROUP BY account, episode"""
TEXT_OF = "date_format({0}, 'yyyy-MM-dd HH:mm:ss') AS {0}"
EPISODE_COLS = ["account", TEXT_OF.format("started"), TEXT_OF.format("ended"), "failures"]


@register("failure_episodes", EPISODES)
def _(spark, d):
    return lockout.failure_episodes(tt.auth_attempts(tt.table(spark, d, "events")), TWO_DAYS).selectExpr(*EPISODE_COLS)


LATE = "to_minutes(10)"


@register("failure_episodes_stream", f"SELECT * FROM ({EPISODES}) WHERE cast(ended as timestamp) + to_seconds({TWO_DAYS}) <= (SELECT max(ts) - {LATE} FROM attempts WHERE NOT success)")
def _(spark, d):
    """Episodes that are over: those still open stay in the state."""
    return drained(lockout.failure_episodes_stream(tt.auth_attempts(events_stream(spark, d)), TWO_DAYS), "episodes").selectExpr(*EPISODE_COLS)


# ---- rate limits and the audit stream ------------------------------------------------

PER_HOUR = "SELECT cast(user_id as varchar) AS key, date_trunc('hour', ts) AS w, count(*) AS requests FROM events GROUP BY 1, 2"
BREACH = ["key", TEXT_OF.format("window_start"), "requests"]


@register("rate_limit_breach", f"SELECT key, {stamp_sql('w')} AS window_start, requests FROM ({PER_HOUR}) WHERE requests > 2")
def _(spark, d):
    return limits.rate_limit_breach(tt.requests(tt.table(spark, d, "events")), 2, "1 hour").selectExpr(*BREACH)


@register("rate_limit_sliding", f"""
SELECT key, {stamp_sql('w')} AS window_start, count(*) AS requests FROM (
  SELECT cast(user_id as varchar) AS key, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * unnest(range(0, 12))) AS w FROM events) GROUP BY 1, 2 HAVING count(*) > 2""")
def _(spark, d):
    return limits.rate_limit_breach(tt.requests(tt.table(spark, d, "events")), 2, "1 hour", "5 minutes").selectExpr(*BREACH)


@register("rate_limit_stream", f"SELECT key, {stamp_sql('w')} AS window_start, requests FROM ({PER_HOUR}) WHERE requests > 2 AND w + to_hours(1) <= (SELECT max(ts) - {LATE} FROM events)")
def _(spark, d):
    return drained(limits.rate_limit_stream(tt.requests(events_stream(spark, d)), 2, "1 hour"), "limits").selectExpr(*BREACH)


ENDPOINT_LIMITS = {"auth": (1, "1 hour"), "upload": (0, "1 minute"), "chat": (2, "1 hour"), "default_minute": (1, "1 minute"), "default_hour": (1, "1 hour")}


@register("rate_limit_endpoints", f"""
SELECT endpoint, key, length, allowed, {stamp_sql('w')} AS window_start, requests FROM (
  SELECT endpoint, key, length, allowed, case when length = '1 minute' then date_trunc('minute', ts) else date_trunc('hour', ts) end AS w, count(*) AS requests
  FROM (SELECT cast(user_id as varchar) AS key, ts, case event_type when 'error' then 'auth' when 'purchase' then 'upload' when 'view' then 'chat' else event_type end AS endpoint FROM events)
  JOIN (VALUES {', '.join(f"('{e}', {n}, '{w}')" for e, (n, w) in ENDPOINT_LIMITS.items())}) l(name, allowed, length)
    ON name = endpoint OR (endpoint NOT IN ('auth', 'upload', 'chat') AND starts_with(name, 'default')) GROUP BY ALL) WHERE requests > allowed""")
def _(spark, d):
    """Event types stand for endpoints; clicks and sign-ups have no limit of their own."""
    e = F.col("event_type")
    endpoint = F.when(e == "error", "auth").when(e == "purchase", "upload").when(e == "view", "chat").otherwise(e)
    asked = tt.table(spark, d, "events").select(endpoint.alias("endpoint"), F.col("user_id").cast("string").alias("key"), "ts")
    return limits.endpoint_breaches(asked, ENDPOINT_LIMITS).withColumn("window_start", stamp("window_start"))


@register("audit_append_stream", "SELECT log_id, company_id, action, status FROM audit_logs")
def _(spark, d):
    out = scratch(spark, "audit-log")
    logs = tt.audit_view(events_stream(spark, d))
    limits.audit_append_stream(logs, f"{out}/rows", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(logs.schema).parquet(f"{out}/rows").select("log_id", "company_id", "action", "status")


@register("audit_windows", f"""
SELECT company_id, {stamp_sql("date_trunc('hour', timestamp)")} AS window_start, count(*) AS events, cast(count_if(status <> 'SUCCESS') as bigint) AS blocked FROM audit_logs GROUP BY 1, 2""")
def _(spark, d):
    return limits.audit_windows(tt.audit_logs(spark, d)).withColumn("window_start", stamp("window_start"))


@register("audit_stream", f"""
SELECT company_id, {stamp_sql('w')} AS window_start, count(*) AS events, cast(count_if(status <> 'SUCCESS') as bigint) AS blocked FROM (SELECT *, date_trunc('hour', timestamp) AS w FROM audit_logs)
WHERE w + to_hours(1) <= (SELECT max(ts) - {LATE} FROM events) GROUP BY 1, 2""")
def _(spark, d):
    return drained(limits.audit_stream(tt.audit_view(events_stream(spark, d))), "audit").withColumn("window_start", stamp("window_start"))


# ---- ingestion -----------------------------------------------------------------------

SHEETS = [
    (",", {"sku": "SKU", "units": "Units Sold", "revenue": "Revenue", "margin": "Margin %", "category": "Category", "name": "Product Name", "channel": "Region"}),
    (";", {"sku": "product_code", "units": "Qty", "revenue": "Net Sales", "margin": "GM%", "category": "Department", "name": "Description", "channel": "Channel"}),
    ("\t", {"sku": "Item Code", "units": "Pieces", "revenue": "Turnover", "margin": "margin_pct", "category": "Class", "name": "Name", "channel": "Store"}),
    ("|", {"sku": "Style", "units": "QUANTITY", "revenue": "Total Revenue", "margin": "Gross Margin", "category": "Dept", "name": "Style Name", "channel": "Market"}),
]


#: A cell with what sheets hold in notes: doubled quotes, line ends, every delimiter.
NOTE = 'first "line"\r\nsecond, line; with | and \t in it'


def written_sheets(spark: SparkSession, d: str) -> str:
    """All trading lines as sheets in four dialects by year, two a dataset, with marks a spreadsheet
    export has and notes in quoted cells of several lines."""
    path = scratch(spark, "sheets")
    base = tt.trading_lines(spark, d).withColumn("folder", F.replace("dataset_id", F.lit(":"), F.lit("_"))).withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(2)))
    dialect = F.pmod(F.element_at(F.split("folder", "_"), 2).cast("int"), F.lit(len(SHEETS)))
    note = F.when(F.pmod(F.xxhash64("row_id"), F.lit(7)) == 0, NOTE)

    def cells(i: int, names: dict) -> dict:
        # Every fourth year gives margins as fractions.
        margin = F.when(F.lit(i == 3), F.col("margin_pct") / 100).otherwise(F.col("margin_pct"))
        return {names["sku"]: F.col("sku"), names["units"]: F.col("units").cast("string"), names["revenue"]: F.concat(F.lit("£"), F.format_number("revenue", 4)),
                names["margin"]: F.concat(margin.cast("string"), F.lit("%" if i == 0 else "")), names["category"]: F.col("category"), names["name"]: F.col("name"),
                names["channel"]: F.col("channel"), "Blank": F.lit(None).cast("string"), "Notes": note}

    line = header = F.lit(None).cast("string")
    for i, (sep, names) in enumerate(SHEETS):
        made = cells(i, names)
        line = F.when(dialect == i, F.to_csv(F.struct(*[c.alias(k) for k, c in made.items()]), {"sep": sep, "escape": '"', "quote": '"'})).otherwise(line)
        header = F.when(dialect == i, F.lit(sep.join(made))).otherwise(header)
    # The header goes before the line that comes first in its sheet: the lines are made and moved once.
    rows = base.select("folder", "part", line.alias("line"))
    place = F.row_number().over(Window.partitionBy("folder", "part").orderBy(F.lit(1)))
    value = F.when(place == 1, F.concat(header, F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    rows.select("folder", "part", value.alias("value")).write.partitionBy("folder", "part").text(path)
    return path


def ingested(spark: SparkSession, d: str) -> DataFrame:
    folder = F.regexp_extract("_metadata.file_path", "folder=([^/]+)/", 1)
    raw, _ = delimited.scan_delimited(spark, written_sheets(spark, d), F.replace(folder, F.lit("_"), F.lit(":")))
    return delimited.clean_lines(raw)


@register("scan_delimited", """
SELECT dataset_id, sku, cast(sum(units) as double) AS units, cast(sum(revenue) as double) AS revenue, round(sum(margin_pct) / count(*), 4) AS margin_pct,
  min(category) AS category, min(name) AS name, count(*) AS n FROM trading_lines GROUP BY 1, 2""")
def _(spark, d):
    """Sheets written, scanned, mapped to roles and cleaned; then summed up per SKU."""
    lines = ingested(spark, d)
    return lines.groupBy("dataset_id", "sku").agg(
        F.sum("units").cast("double").alias("units"), F.sum("revenue").cast("double").alias("revenue"),
        F.round(F.sum("margin_pct") / F.count("*"), 4).alias("margin_pct"), F.min("category").alias("category"), F.min("name").alias("name"), F.count("*").alias("n"))


@register("ingest_kpis", """
SELECT dataset_id, sku_count, total_revenue, total_units, avg_margin_pct, 0 AS reorder_count, 0 AS markdown_risk_count, 'explicit' AS margin_source FROM kpis""")
def _(spark, d):
    """KPIs of ingested sheets that have no stock, cover and sell-through columns."""
    k = rollup.dataset_kpis(rollup.sku_rollup(ingested(spark, d)))
    return k.select("dataset_id", "sku_count", "total_revenue", "total_units", "avg_margin_pct", "reorder_count", "markdown_risk_count", "margin_source")


@register("resolve_roles", """
SELECT ['SKU', 'product_code', 'Item Code', 'Style'][y % 4 + 1] AS sku_header, count(*) AS n FROM (SELECT cast(split_part(dataset_id, ':', 2) as int) AS y FROM trading_lines) GROUP BY 1""")
def _(spark, d):
    """Lines per header the SKU role was found under, over all written sheets."""
    found = delimited.parsed(spark, written_sheets(spark, d))
    names = found.where("n < 0").select("file", F.col("found")["sku"].alias("sku_header"))
    return found.where("n >= 0").groupBy("file").agg(F.count("sku").alias("n")).join(names, "file").groupBy("sku_header").agg(F.sum("n").alias("n"))


@register("require_roles", """
SELECT replace(dataset_id, ':', '_') AS folder, 'Missing required columns: Revenue. Found columns: SKU, Qty, Colour.' AS reason FROM (SELECT DISTINCT dataset_id FROM trading_lines)
WHERE cast(split_part(dataset_id, ':', 2) as int) % 2 = 0""")
def _(spark, d):
    """Sheets of even years lack revenue and are rejected."""
    path = scratch(spark, "incomplete")
    lines = tt.trading_lines(spark, d).withColumn("folder", F.replace("dataset_id", F.lit(":"), F.lit("_")))
    even = F.pmod(F.element_at(F.split("folder", "_"), 2).cast("int"), F.lit(2)) == 0
    cells = [F.col("folder"), F.col("sku").alias("SKU"), F.col("units").alias("Qty")]
    lines.where(even).select(*cells, F.lit("red").alias("Colour")).write.partitionBy("folder").option("header", True).csv(path)
    lines.where(~even).select(*cells, F.col("revenue").alias("Sales")).write.partitionBy("folder").mode("append").option("header", True).csv(path)
    _, rejected = delimited.scan_delimited(spark, path)
    return rejected.select(F.regexp_extract("file", "folder=([^/]+)/", 1).alias("folder"), "reason").distinct()


@register("drop_empty", "SELECT o_orderkey AS \"order\", o_totalprice AS total FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, d):
    """Orders with ghost cells: an empty column, an unnamed one, empty rows, padded names."""
    filled = F.pmod("o_orderkey", F.lit(10)) != 0
    sheet = tt.table(spark, d, "orders").select(
        F.when(filled, F.col("o_orderkey")).alias(" order "), F.when(filled, F.col("o_totalprice")).alias("total"), F.lit(None).cast("string").alias("ghost"),
        F.when(filled, F.lit("x")).alias("Unnamed: 3"))
    return delimited.drop_empty(sheet)


@register("file_inventory", """
SELECT source AS key, cast(sum(strlen(text) + 1) as bigint) AS size, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256, 'txt' AS extension
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(spark, d):
    """Inventory of one text file per source, of all its documents in order; files above 128 kB
    are hashed as a stream."""
    path = scratch(spark, "files")
    texts = tt.table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("source").alias("key"), "doc_id", "text")
    texts.repartition("key").sortWithinPartitions("key", "doc_id").select("key", "text").write.partitionBy("key").text(path)
    files = delimited.file_inventory(spark, path, large=1 << 17)
    return files.select(F.regexp_extract("path", "key=([^/]+)/", 1).alias("key"), "size", "sha256", "extension")


# Without its native library Hadoop's local file system with checksums starts four processes for the mode of
# each file it writes, the one below it none. Other file systems don't read these options.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@register("supplier_inventory", """
SELECT l_suppkey AS key, cast(sum(strlen(line) + 1) as bigint) AS size, sha256(string_agg(line || chr(10), '' ORDER BY line)) AS sha256, 'txt' AS extension
FROM (SELECT l_suppkey, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) AS line FROM lineitem) GROUP BY 1""")
def _(spark, d):
    """Inventory of one text file per supplier, of all its lines in order."""
    path = scratch(spark, "files")
    line = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    lines = tt.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), line.alias("line"))
    lines.repartition("key").sortWithinPartitions("key", "line").write.options(**PLAIN_LOCAL).partitionBy("key").text(path)
    files = delimited.file_inventory(spark, path)
    return files.select(F.regexp_extract("path", "key=([0-9]+)/", 1).cast("long").alias("key"), "size", "sha256", "extension")


@register("unreadable_cells", """
SELECT l_orderkey AS sku, CASE WHEN l_orderkey % 2 = 0 THEN 'revenue' ELSE 'units' END AS role,
  CASE WHEN l_orderkey % 2 = 0 THEN '5012345678901234567' ELSE '1e400' END AS cell, count(*) AS n FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1, 2, 3""")
def _(spark, d):
    """Sheets in which every fifth order has a number beyond its column."""
    path, big, odd = scratch(spark, "huge"), F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") % 2 == 1
    cells = tt.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("SKU"), F.lit("red").alias("Colour"), F.when(big & odd, "1e400").otherwise(F.col("l_quantity").cast("string")).alias("Units"),
        F.when(big & ~odd, "5012345678901234567").otherwise(F.col("l_extendedprice").cast("string")).alias("Sales"))
    cells.write.option("header", True).csv(path)
    raw, _ = delimited.scan_delimited(spark, path)
    # The staged rows pack so well that a join would broadcast millions of them through the driver.
    lost = delimited.unreadable_cells(raw, keep=("sku",)).withColumn("sku", F.col("sku").cast("bigint"))
    return lost.groupBy("sku", "role", "cell").agg(F.count("*").alias("n"))
