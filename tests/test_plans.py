"""Properties of physical plans that matter at scale."""

import io
import contextlib

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", ["best_sellers", "reorder_alerts", "markdown_risk", "recent_audit", "audit_security_events", "chat_context"])
def test_top_k_is_cut_before_the_shuffle(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("key", ["sku_rollup", "best_sellers", "dataset_kpis", "weekly_trend", "channel_split", "category_scorecard", "tenant_scope", "tenant_rows",
                                 "audit_stats", "mask_standard", "file_scan", "injection_flags", "rate_limit_breach", "plan_fold", "quota_check"])
def test_no_python_and_no_cross_join(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["sku_rollup"](spark, sf_dir))
    assert "partial_max_by" in text and "partial_sum" in text


def test_lines_joined_with_parts_are_not_moved_again(spark, sf_dir):
    from tradeloom.operators import rollup
    from tradeloom.sources import testtables

    text = plan(rollup.sku_groups(testtables.trading_lines(spark, sf_dir), ("revenue",), ("name",)))
    assert "partial_max_by" in text and "hashpartitioning(sku" not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(QUERIES["weekly_trend"](spark, sf_dir))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema") and "l_orderkey" in line]
    assert schemas and all("l_tax" not in s and "l_quantity" not in s for s in schemas)


def test_cleaning_compiles(spark, tmp_path):
    """The code of all numeric roles together stays far below what one compiled method may hold."""
    import re

    from tradeloom.sources import delimited
    from tradeloom.sources.roles import ROLE_HEADERS

    heads = [names[0] for names in ROLE_HEADERS.values()]
    (tmp_path / "all.csv").write_text(",".join(heads) + "\n" + ",".join("1" for _ in heads) + "\n")
    raw, _ = delimited.scan_delimited(spark, str(tmp_path))
    lines, out = delimited.clean_lines(raw), io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        with contextlib.redirect_stdout(out):
            lines.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", out.getvalue())]
    assert sizes and all(0 < n < 64_000 for n in sizes)


def test_unreadable_cells_are_not_joined_with_all_rows(spark, sf_dir):
    assert "Join" not in plan(QUERIES["unreadable_cells"](spark, sf_dir))
