import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import role_view, rollup, timeline, workspace


def weeks(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, week string, revenue double")


def totals(spark, *ids):
    return spark.createDataFrame([(i, 5200.0) for i in ids], "dataset_id string, total_revenue double")


def test_sparkline_padding_and_ramp(spark):
    got = {}
    for r in role_view.sparkline(totals(spark, "few", "none", "many"), weeks(
            spark, [("few", "9", 100.0), ("few", "10", 200.0)] + [("many", str(w), float(w)) for w in range(1, 13)])).orderBy("point").collect():
        got.setdefault(r.dataset_id, []).append(r.value)
    assert got["few"] == pytest.approx([round(100 * 0.95 ** k, 2) for k in range(6, 0, -1)] + [100.0, 200.0])
    assert got["many"] == [float(w) for w in range(5, 13)]
    assert got["none"] == pytest.approx([round(100 * (0.85 + 0.03 * i + (0.05 if i % 3 == 0 else 0)), 2) for i in range(8)])


def test_trend_and_period_sort_weeks_by_value(spark):
    w = weeks(spark, [("up", str(i), float(i)) for i in range(1, 12)] + [("flat", "1", 5.0)] + [("date", "2024-01-08", 1.0), ("date", "2023-12-25", 2.0)])
    assert {r.dataset_id: r.trend for r in role_view.trend_direction(w).collect()} == {"up": "improving", "flat": "stable", "date": "declining"}
    assert {r.dataset_id: r.period for r in timeline.periods(w).collect()} == {"up": "1 – 11", "flat": "1", "date": "2023-12-25 – 2024-01-08"}


def test_scan_uploads_filters_and_cuts(spark):
    df = spark.createDataFrame([(f"d{i}", "u" if i % 2 else "v", "f.csv", dt.datetime(2024, 1, 1 + i), 1) for i in range(9)],
                               "dataset_id string, user_id string, filename string, created_at timestamp, file_size int")
    assert [r.dataset_id for r in workspace.scan_uploads(df, "u", 2).collect()] == ["d7", "d5"]


def test_tags_are_cleaned(spark):
    df = spark.createDataFrame([([" a ", "", "b" * 40] + [f"t{i}" for i in range(20)],)], "t array<string>").select(workspace.clean_tags(F.col("t")).alias("t"))
    tags = df.first().t
    assert tags[:2] == ["a", "b" * 40] and len(tags) == 22


def test_role_actions_are_padded_to_six(spark, make_lines):
    from tradeloom.operators import alerts

    sku = rollup.sku_rollup(make_lines([{"sku": "s"}]))
    cats = rollup.category_scorecard(sku)
    h = role_view.heads(rollup.dataset_kpis(sku), alerts.best_sellers(sku), alerts.reorder_alerts(sku), alerts.markdown_risk(sku), cats)
    got = role_view.role_actions(h).orderBy("rank").collect()
    assert [(r["rank"], r.sku) for r in got] == [(1, "s"), (2, "OTB Review")] + [(i, "Range Review") for i in range(3, 7)]
    assert [r.risk[:16] for r in role_view.top_risks(h).orderBy("pos").collect()] == ["Monitor sell-thr", "Average stock co", "Gross margin at "]


def test_no_dataset_of_a_user_is_lost(spark):
    """250 datasets of one user, in every workspace and timeline operator."""
    from tradeloom.operators import timeline, workspace

    ids = spark.range(250).select(F.format_string("d%03d", "id").alias("dataset_id"), "id")
    datasets = ids.selectExpr(
        "dataset_id", "'u' AS user_id", "'c' AS company_id", "concat('f', id, '.csv') AS filename", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) AS created_at", "cast(5 as bigint) AS file_size",
        "named_struct('display_name', cast(null as string), 'analysed_at', cast(null as timestamp_ntz), 'dataset_type', cast(null as string), 'status', cast(null as string), 'tags', array('t'), 'archived', false, 'trashed', false) AS workspace")
    kpis = ids.selectExpr("dataset_id", "cast(10 as bigint) AS sku_count", "cast(id * 100 as double) AS total_revenue", "50.0D AS avg_margin_pct", "50.0D AS gross_margin_pct", "cast(id % 50 as double) AS avg_sell_through", "6.0D AS avg_cover_weeks",
                          "cast(1 as bigint) AS reorder_count", "cast(2 as bigint) AS markdown_risk_count", "cast(0 as bigint) AS critical_oos_count", "true AS margin_available", "0 AS role_mask")
    cards = workspace.dataset_cards(workspace.catalogue(datasets), kpis)
    assert cards.count() == 250 and workspace.workspace_counts(cards).first().total == 250 and workspace.tag_cloud(cards).first().datasets == 250
    assert workspace.workspace_filter(cards, "active", "f").count() == 250
    points = timeline.timeline(datasets, kpis)
    assert sorted(r.seq for r in points.collect()) == list(range(1, 251))
    assert timeline.timeline_delta(points).where("metric = 'Revenue'").count() == 248 and timeline.business_memory(points).where("metric = 'revenue'").count() == 249
    risks = ids.selectExpr("dataset_id", "array(concat('r', id), 'a', 'b') AS risks")
    assert timeline.risk_diff(points, risks).where("kind = 'new'").count() == 249
    assert timeline.review_moves(points).where("rev_delta IS NOT NULL").count() == 248


def test_recent_audit_honours_its_limit(spark):
    from tradeloom.operators import governance

    logs = spark.range(600).selectExpr("id AS log_id", "'c' AS company_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) AS timestamp")
    assert governance.recent_audit(logs, 500).count() == 500
