import pytest
from pyspark.sql import functions as F

from tradeloom.operators import alerts, category, health, rollup


def test_last_and_first_follow_file_order(make_lines):
    rows = [{"sku": "s", "stock": 5, "name": None}, {"sku": "s", "stock": 0, "name": "A"}, {"sku": "s", "stock": 7, "name": "B"}]
    lines = make_lines(rows)
    for parts in (1, 3, 8):
        got = rollup.sku_rollup(lines.repartition(parts)).first()
        assert (got.stock, got.name, float(got.units)) == (7.0, "A", 3.0)


def test_lines_without_sku_count_only_in_weeks(make_lines):
    lines = make_lines([{"sku": "a", "week": "1", "channel": "x"}, {"sku": None, "week": "1", "channel": "x"}, {"sku": "a", "week": None, "channel": None}])
    assert rollup.dataset_kpis(rollup.sku_rollup(lines)).first().total_revenue == 20.0
    assert [tuple(r) for r in rollup.weekly_trend(lines).collect()] == [("d", "1", 20.0)]
    shares = rollup.channel_split(lines.where("sku is null or week is not null"), rollup.dataset_kpis(rollup.sku_rollup(lines.limit(1))))
    assert shares.first().share_pct == 200.0


@pytest.mark.parametrize("stock, cover, st, want", [
    (0, 10, 50, "CRITICAL"), (5, 1.0, 50, "CRITICAL"), (5, 1.1, 50, "URGENT"), (5, 2.0, 50, "URGENT"), (5, 2.1, 50, "REORDER"), (5, 4.0, 50, "REORDER"),
    (5, 4.1, 50, None), (19, 10, 70, "REORDER"), (20, 10, 70, None), (19, 10, 69.9, None)])
def test_reorder_bounds(make_lines, stock, cover, st, want):
    sku = rollup.sku_rollup(make_lines([{"sku": "s", "stock": stock, "cover_weeks": cover, "sell_through": st}]))
    got = alerts.reorder_alerts(sku).collect()
    assert [r.urgency for r in got] == ([want] if want else [])


@pytest.mark.parametrize("st, stock, want", [(14.9, 1, ("CLEARANCE", "40–50%")), (15, 1, ("DEEP", "25–35%")), (21.9, 1, ("DEEP", "25–35%")),
                                             (22, 1, ("TACTICAL", "15–20%")), (29.9, 1, ("TACTICAL", "15–20%")), (30, 1, None), (10, 0, None)])
def test_markdown_bounds(make_lines, st, stock, want):
    got = alerts.markdown_risk(rollup.sku_rollup(make_lines([{"sku": "s", "sell_through": st, "stock": stock}]))).collect()
    assert [(r.severity, r.recommended_depth) for r in got] == ([want] if want else [])


def test_absent_roles_change_rules(make_lines):
    base = {"sku": "s", "sell_through": 75}
    no_stock = rollup.sku_rollup(make_lines([base]))
    assert alerts.reorder_alerts(no_stock).first().stock is None
    assert alerts.reorder_alerts(no_stock).first().urgency == "REORDER"
    empty_stock = rollup.sku_rollup(make_lines([{**base, "stock": 0}]))
    assert alerts.reorder_alerts(empty_stock).first().urgency == "CRITICAL"
    nothing = rollup.sku_rollup(make_lines([{"sku": "s"}]))
    assert alerts.reorder_alerts(nothing).count() == 0 and alerts.markdown_risk(nothing).count() == 0
    assert alerts.markdown_risk(rollup.sku_rollup(make_lines([{"sku": "s", "sell_through": 10}]))).count() == 1


@pytest.mark.parametrize("cells, source, pct", [
    ({"margin_pct": 40, "margin_value": 9}, "explicit", 40), ({"margin_value": 2.5}, "margin_value_over_revenue", 25),
    ({"retail": 20, "cost": 5}, "cost_and_retail", 75), ({"cost": 5}, None, None), ({"retail": 0, "cost": 5}, "cost_and_retail", None)])
def test_margin_sources(make_lines, cells, source, pct):
    got = rollup.derive_margin(make_lines([{"sku": "s", **cells}])).first()
    assert (got.margin_source, got.margin_pct) == (source, pct)


def test_blended_margin_branches(make_lines):
    two = lambda **k: [{"sku": "a", "revenue": 100, **{c: v[0] for c, v in k.items()}}, {"sku": "b", "revenue": 300, **{c: v[1] for c, v in k.items()}}]
    kpi = lambda rows: rollup.dataset_kpis(rollup.sku_rollup(rollup.derive_margin(make_lines(rows)))).first()
    by_value = kpi(two(margin_pct=(50, 10), margin_value=(20, 60)))
    assert (by_value.gross_margin_pct, by_value.gross_profit, by_value.avg_margin_pct) == (20.0, 80.0, 30.0)
    weighted = kpi(two(margin_pct=(50, 10)))
    assert (weighted.gross_margin_pct, weighted.gross_profit) == (20.0, 80.0)
    bare = kpi([{"sku": "a"}])
    assert (bare.gross_margin_pct, bare.gross_profit, bare.margin_available, bare.margin_source) == (0.0, 0.0, False, None)


@pytest.mark.parametrize("st, want", [(None, "UNKNOWN"), (0.0, "UNKNOWN"), (14.9, "CRITICAL"), (15.0, "AT RISK"), (25.0, "HEALTHY"), (40.0, "STRONG")])
def test_category_health(spark, st, want):
    df = spark.createDataFrame([(st,)], "st double").select(health.category_health(F.col("st")).alias("h"))
    assert df.first().h == want


def kpi_row(spark, **k):
    row = {"dataset_id": "d", "avg_sell_through": 50.0, "gross_margin_pct": 50.0, "avg_margin_pct": 50.0, "avg_cover_weeks": 6.0, "reorder_count": 0,
           "critical_oos_count": 0, "markdown_risk_count": 0, "margin_available": True, **k}
    schema = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for c, v in row.items())
    return {r.component: r for r in health.health_breakdown(spark.createDataFrame([tuple(row.values())], schema)).collect()}


@pytest.mark.parametrize("cover, points", [(0.0, 3), (1.0, 7), (2.0, 13), (4.0, 18), (8.0, 18), (8.1, 13), (12.0, 13), (12.1, 7), (16.0, 7), (16.1, 3)])
def test_cover_bands(spark, cover, points):
    assert kpi_row(spark, avg_cover_weeks=cover)["stock"].score == points


@pytest.mark.parametrize("critical, reorder, markdown, points", [(0, 0, 0, 10), (2, 0, 0, 6), (3, 0, 0, 5), (0, 4, 0, 10), (0, 5, 0, 9), (0, 15, 0, 7), (0, 99, 99, 5), (9, 99, 99, 0)])
def test_risk_points(spark, critical, reorder, markdown, points):
    assert kpi_row(spark, critical_oos_count=critical, reorder_count=reorder, markdown_risk_count=markdown)["risk"].score == points


def test_health_without_margin(spark):
    got = kpi_row(spark, margin_available=False, gross_margin_pct=0.0, avg_margin_pct=0.0)
    assert (got["margin"].score, got["margin"].status) == (10, "watch")
    assert got["risk"].detail == "No critical stock or margin risks detected."
    assert sum(r.score for r in got.values()) == got["risk"].total


def test_slow_movers_fall_back_to_sellers(make_lines):
    rows = [{"sku": f"s{i}", "revenue": 100 - i, "category": "Cat", "sell_through": 40 + i, "stock": 50} for i in range(8)]
    best = alerts.best_sellers(rollup.sku_rollup(make_lines(rows)))
    none = alerts.markdown_risk(rollup.sku_rollup(make_lines(rows)))
    assert [r.sku for r in category.category_slow_movers(best, none).orderBy("rank").collect()] == ["s5", "s6", "s7"]


def test_few_rows_are_sorted_for_the_first_k(spark):
    """Rows below what k rows reach are left out before the sort; without enough values all stay."""
    from pyspark.sql import functions as F

    from tradeloom.operators import alerts

    many = spark.range(20000).select(F.lit("a").alias("dataset_id"), F.col("id").cast("string").alias("sku"), (F.col("id") % 7000).cast("decimal(18,4)").alias("revenue"))
    few = spark.range(30).select(F.lit("b").alias("dataset_id"), F.col("id").cast("string").alias("sku"), F.when(F.col("id") < 5, F.lit(1)).cast("decimal(18,4)").alias("revenue"))
    equal = spark.range(50).select(F.lit(None).cast("string").alias("dataset_id"), F.col("id").cast("string").alias("sku"), F.lit(1).cast("decimal(18,4)").alias("revenue"))
    rows = many.unionByName(few).unionByName(equal)
    order = [F.desc("revenue"), F.asc("sku")]
    near = alerts.in_reach(rows, ["dataset_id"], "revenue", "sku", 20)
    kept = {r.dataset_id: r["count"] for r in near.groupBy("dataset_id").count().collect()}
    assert kept["b"] == 30 and kept[None] == 50 and 20 <= kept["a"] < 200
    first = lambda df: sorted(map(str, alerts.top_per(df, ["dataset_id"], order, 20).collect()))
    assert first(near) == first(rows)


def test_first_values_with_gaps_carry_the_place_once(spark, make_lines):
    import contextlib
    import io

    from tradeloom.operators.rollup import sku_rollup
    from tradeloom.sources.store import merged_rollup, partial_rollup

    from pyspark.sql import functions as F

    full = {"category": "x", "channel": "web", "name": "n", "brand": "z", "buy_qty": 4}
    rows = [{"sku": "s", **full, "category": None, "name": "early"}, {"sku": "s", **full}, {"sku": "s", **full, "category": "late", "brand": None},
            {"sku": "t", "name": None}, {"sku": "t", "name": "only"}, {"sku": "u", **full, "buy_qty": None}, {"sku": "u", **full, "category": "y"}]
    lines = make_lines(rows, {*full, "stock", "sell_through", "cover_weeks"})
    want = {("s", "x", "web", "early", "z", 4.0), ("t", None, None, "only", None, None), ("u", "x", "web", "n", "z", 4.0)}
    sheets = lines.withColumn("sheet", F.when(F.col("row_id") % 2 == 0, "one").otherwise("two"))
    for found in (sku_rollup(lines), merged_rollup(partial_rollup(sheets))):
        assert {(r.sku, r.category, r.channel, r.name, r.brand, r.buy_qty) for r in found.collect()} == want
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            found.explain()
        assert "min_by(category" not in out.getvalue()


def test_book_keeps_only_sku_columns_that_are_read(spark, make_lines):
    """KPIs need no first values; a dataset whose lines have no SKU stays in the dataset table, taken from the staged SKU rows."""
    from tradeloom.plans.book import AnalysisBook

    catalogue = lambda rows: rows.groupBy("dataset_id").agg(F.max("role_mask").alias("role_mask"))
    lines = make_lines([{"sku": "a", "category": "x", "name": "n", "channel": "c", "brand": None, "week": "1"}, {"sku": "a", "category": "y", "brand": "b"},
                        {"sku": None, "category": "z", "week": "2", "channel": "c"}, {"dataset_id": "e", "sku": None}])
    few, all_of = AnalysisBook(lines, catalogue).prepare("kpis"), AnalysisBook(lines, catalogue)
    assert not {"category", "name", "brand", "cost"} & set(few.skus().columns)
    assert [r.dataset_id for r in few.datasets.orderBy("dataset_id").collect()] == ["d", "e"]
    assert few.datasets.count() == all_of.datasets.count()
    assert few.kpis.collect() == [r for r in all_of.tables()["kpis"].collect()] and few.kpis.first().sku_count == 1
    assert few.categories.first().category == "x" and "category" in few.skus().columns and few.rollup.first().brand == "b"
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(few.rollup) == whole(rollup.sku_rollup(lines))
    assert whole(few.weekly) == whole(rollup.weekly_trend(lines)) and whole(few.channels) == whole(rollup.channel_split(lines, few.kpis))


def test_kpis_alone_store_no_sku_rows(make_lines):
    from tradeloom.plans.book import AnalysisBook

    lines = make_lines([{"sku": s, "dataset_id": d, "revenue": 7, "stock": 1, "margin_pct": 30} for s, d in [("a", "d"), ("a", "d"), (None, "d"), ("b", "e"), (None, "f")]])
    catalogue = lambda rows: rows.groupBy("dataset_id").agg(F.max("role_mask").alias("role_mask"))
    few, all_of = AnalysisBook(lines, catalogue).prepare("kpis"), AnalysisBook(lines, catalogue).prepare("kpis", "categories")
    assert few._groups is None and all_of._groups is not None
    rows = lambda df: sorted(df.collect())
    assert few.kpis.schema == all_of.kpis.schema and rows(few.kpis) == rows(all_of.kpis) and few.kpis.count() == 2
    assert rows(few.datasets) == rows(all_of.datasets) and few.datasets.count() == 3


def test_lists_come_from_few_rows(spark):
    """All three lists from the rows in reach are those from all rows, over ties, gaps and a small dataset."""
    from tradeloom.sources.roles import ALL_ROLES

    n = F.col("id")
    rows = spark.range(20000).select(
        F.when(n < 15, "small").when(n < 30, F.lit(None)).otherwise("d").alias("dataset_id"), F.col("id").cast("string").alias("sku"),
        F.lit(1).cast("decimal(28,2)").alias("units"),
        F.when(n % 11 != 0, (n * 37 % 9001) / 1000 + F.when(n % 3 == 0, 9).otherwise(0)).cast("decimal(28,4)").alias("revenue"),
        F.lit(30.0).alias("margin_pct"), (n % 25).cast("double").alias("stock"), (n * 7 % 100).cast("double").alias("sell_through"),
        (n % 9).cast("double").alias("cover_weeks"), F.lit("c").alias("category"), F.lit("n").alias("name"), F.lit(ALL_ROLES).alias("role_mask"))
    few, found = alerts.contenders(rows), lambda df: sorted(map(str, df.collect()))
    assert few.columns == rows.columns and few.where("dataset_id = 'd'").count() < 4000
    assert few.where("dataset_id = 'small' or dataset_id is null").count() == 30
    assert found(alerts.best_of(few)) == found(alerts.best_of(rows))
    assert found(alerts.reorder_of(alerts.reorder_candidates(few))) == found(alerts.reorder_of(alerts.reorder_candidates(rows)))
    assert found(alerts.markdown_of(alerts.markdown_candidates(few))) == found(alerts.markdown_of(alerts.markdown_candidates(rows)))


def test_weeks_alone_need_no_channel(make_lines):
    from tradeloom.plans.book import AnalysisBook

    lines = make_lines([{"sku": s, "week": w, "channel": c, "revenue": v} for s, w, c, v in [("a", "1", "x", 5), ("a", "1", None, 6), (None, "2", "y", 7), ("b", None, "y", 8)]])
    alone, both = AnalysisBook(lines).prepare("weekly"), AnalysisBook(lines).prepare("periods", "kpis")
    assert "periods" not in vars(alone) and "periods" in vars(both)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(alone.weekly) == rows(both.weekly) == rows(rollup.weekly_trend(lines)) and len(rows(alone.weekly)) == 2
    assert rows(both.channels) == rows(rollup.channel_split(lines, both.kpis))
