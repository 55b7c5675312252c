from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tradeloom.operators import actions, alerts, health, rollup

line = st.fixed_dictionaries({
    "dataset_id": st.sampled_from(["d1", "d2"]), "sku": st.sampled_from(list("abcdefgh")), "units": st.integers(0, 50), "revenue": st.integers(0, 9999),
    "stock": st.integers(0, 40), "cover_weeks": st.integers(0, 12), "sell_through": st.integers(0, 100), "margin_pct": st.integers(0, 80),
    "category": st.sampled_from(["x", "y", "z"]), "name": st.sampled_from([None, "n1", "n2"])})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(line, min_size=1, max_size=30))
def test_analysis_invariants(make_lines, rows):
    lines = make_lines(rows, roles={"stock", "cover_weeks", "sell_through", "margin_pct", "category", "name"})
    sku = rollup.sku_rollup(lines)
    kpis = rollup.dataset_kpis(sku)
    total = {r.dataset_id: r.total_revenue for r in kpis.collect()}
    for d in total:
        assert total[d] == sum(r["revenue"] for r in rows if r["dataset_id"] == d)
    again = rollup.dataset_kpis(rollup.sku_rollup(lines.repartition(5)))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, kpis.collect()), key=str)
    alone = rollup.dataset_kpis(rollup.sku_rollup(lines.where("dataset_id = 'd1'"))).collect()
    assert alone == kpis.where("dataset_id = 'd1'").collect()
    skus = {(r.dataset_id, r.sku) for r in sku.collect()}
    reorder, markdown = alerts.reorder_alerts(sku), alerts.markdown_risk(sku)
    for df in (reorder, markdown, alerts.best_sellers(sku)):
        assert {(r.dataset_id, r.sku) for r in df.collect()} <= skus
    for r in health.health_breakdown(kpis).groupBy("dataset_id").agg(F.sum("score").alias("s"), F.max("total").alias("t")).collect():
        assert 0 <= r.t <= 100 and r.s == r.t
    ranked = actions.action_centre(markdown, reorder, rollup.category_scorecard(sku), kpis).collect()
    for d in total:
        mine = sorted((r for r in ranked if r.dataset_id == d), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r.priority_score for r in mine] == sorted((r.priority_score for r in mine), reverse=True)
