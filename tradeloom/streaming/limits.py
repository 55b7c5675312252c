"""Rate limits and the audit stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Requests allowed per window and endpoint.
LIMITS = {"auth": (10, "1 minute"), "upload": (30, "1 hour"), "chat": (60, "1 minute"), "report": (10, "1 hour"),
          "export": (20, "1 hour"), "api": (120, "1 minute"), "default_minute": (300, "1 minute"), "default_hour": (3000, "1 hour")}


def request_key(ip: Column, user: Column) -> Column:
    """Address and user, or the address alone for callers without a session."""
    return F.when(F.coalesce(user, F.lit("")) != "", F.concat_ws(":", ip, user)).otherwise(ip)


def window_counts(requests: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Requests per key and window; sums combine map-side, so a flooding key is cheap.

    Sliding windows of a batch are summed from counts per slide step (the step must divide
    the length), so it is the counts that are copied into overlapping windows, not requests.
    """
    if slide is None:
        return requests.groupBy(F.window("ts", length).alias("w"), "key").agg(F.count("*").alias("requests"))
    if requests.isStreaming:
        return requests.groupBy(F.window("ts", length, slide).alias("w"), "key").agg(F.count("*").alias("requests"))
    steps = requests.groupBy(F.window("ts", slide).alias("s"), "key").agg(F.count("*").alias("n")).select(
        F.col("s.start").alias("ts"), "key", "n")
    return steps.groupBy(F.window("ts", length, slide).alias("w"), "key").agg(F.sum("n").alias("requests"))


def rate_limit_breach(requests: DataFrame, limit: int, length: str, slide: str | None = None) -> DataFrame:
    """Windows in which a key made more requests than allowed (batch or stream)."""
    return window_counts(requests, length, slide).where(F.col("requests") > limit).select(
        "key", F.col("w.start").alias("window_start"), "requests")


def endpoint_breaches(requests: DataFrame, limits: dict[str, tuple[int, str]] = LIMITS) -> DataFrame:
    """Breaches of each endpoint's own limit; endpoints without one use the default limits.

    ``requests``: endpoint, key, ts. The limits are constants of the plan. Counts of both
    window lengths come from one aggregate.
    """
    named = [e for e in limits if not e.startswith("default")]
    known = F.col("endpoint").isin(named)
    table = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.lit(n).alias("allowed"), F.lit(w).alias("length")) for e, (n, w) in limits.items()])
    fits = lambda r: F.when(known, r["endpoint"] == F.col("endpoint")).otherwise(r["endpoint"].startswith("default"))
    due = requests.select("endpoint", "key", "ts", F.inline(F.transform(F.filter(table, fits), lambda r: F.struct(r["allowed"].alias("allowed"), r["length"].alias("length")))))
    start = F.when(F.col("length") == "1 minute", F.date_trunc("minute", "ts")).otherwise(F.date_trunc("hour", "ts"))
    counts = due.groupBy("endpoint", "key", "length", "allowed", start.alias("window_start")).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > F.col("allowed"))


def rate_limit_stream(requests: DataFrame, limit: int, length: str, late: str = "10 minutes") -> DataFrame:
    return rate_limit_breach(requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), limit, length)


def audit_windows(logs: DataFrame, length: str = "1 hour") -> DataFrame:
    """Events and blocked events per company and window."""
    blocked = F.col("status").isin("FAILURE", "BLOCKED")
    return logs.groupBy(F.window("timestamp", length).alias("w"), "company_id").agg(
        F.count("*").alias("events"), F.count_if(blocked).alias("blocked")).select(
        "company_id", F.col("w.start").alias("window_start"), "events", "blocked")


def audit_append_stream(logs: DataFrame, path: str, checkpoint: str):
    """Append audit records to a table as they arrive; started by the caller's trigger."""
    return logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def audit_stream(logs: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    stamped = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return audit_windows(stamped, length)
