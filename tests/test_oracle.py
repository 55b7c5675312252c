"""Registered queries against their SQL at the smallest scale. ALL_QUERIES=1 runs every key."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = ["sku_rollup", "dataset_kpis", "channel_split", "health_breakdown", "blended_margin", "role_actions", "action_evidence", "action_centre", "category_detail",
          "trade_report", "compare_skus", "compare_commentary", "risk_diff", "trading_review", "latest_dataset", "workspace_update", "tenant_scope", "tenant_rows",
          "rbac_allowed", "quota_check", "settings_apply", "profile_seed", "mask_private", "file_scan", "plan_fold", "login_lockout", "failure_episodes",
          "rate_limit_sliding", "billing_dedup_stream", "login_lockout_stream", "scan_delimited"]
KEYS = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, sf_dir, key):
    got, want = QUERIES[key](spark, sf_dir).toPandas(), duck.execute(ORACLES[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_known_counts(spark, sf_dir):
    """Counts at the smallest scale; category health as means in pandas give it."""
    from pyspark.sql import functions as F

    from tradeloom.operators import alerts
    from tradeloom.plans.book import AnalysisBook

    b = AnalysisBook.of_test_tables(spark, sf_dir)
    per = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    assert (b.lines.count(), b.rollup.count(), b.categories.count()) == (6000, 4010, 873)
    assert str(b.lines.agg(F.sum("revenue")).first()[0]) == "301270840.1572"
    assert per(alerts.reorder_candidates(b.rollup), "urgency") == {"CRITICAL": 259, "URGENT": 189, "REORDER": 555}
    assert per(alerts.markdown_candidates(b.rollup), "severity") == {"CLEARANCE": 1275, "DEEP": 345, "TACTICAL": 370}
    assert per(b.categories, "health") == {"STRONG": 331, "HEALTHY": 209, "AT RISK": 125, "CRITICAL": 208}
    attempts = QUERIES["login_lockout"](spark, sf_dir)
    assert per(attempts, "status") == {"SUCCESS": 196, "FAILURE": 201, "BLOCKED": 3} and attempts.where("locked").count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() == 700


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
