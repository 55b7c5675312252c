import pytest
from pyspark.sql import functions as F

from tradeloom.functions.money import gbp_compact
from tradeloom.functions.numbers import clean_numeric, or_default, safe_float, whole
from tradeloom.operators.rollup import fix_decimal_percent

MESSY = {
    "£44,400": 44400, "$2,500.00": 2500, "€3100": 3100, "29.8%": 29.8, " 1 234 ": 1234, "-20%": -20, "-": 0, "N/A": 0, "n/a": 0, "nan": 0,
    "None": 0, "": 0, "(1,200)": 0, "12d": 0, "1.234,56": 1.23456, "1e5": 100000, "Infinity": 0, "¥5": 5, "₹7": 7, ".5": 0.5, "+3": 3,
}


def test_messy_numbers(spark):
    df = spark.createDataFrame([(k,) for k in MESSY], "t string").withColumn("v", clean_numeric(F.col("t")))
    assert {r.t: r.v for r in df.collect()} == pytest.approx(MESSY)


@pytest.mark.parametrize("values, want", [
    ([0.298, 0.5], [29.8, 50.0]), ([0.3, 2.0], [0.3, 2.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.5, -0.2], [150.0, -20.0])])
def test_percent_fixer(spark, values, want):
    df = spark.createDataFrame([("d", i, v, v, v) for i, v in enumerate(values)], "dataset_id string, i int, margin_pct double, sell_through double, cover_weeks double")
    got = fix_decimal_percent(df).orderBy("i").collect()
    assert [r.margin_pct for r in got] == pytest.approx(want)
    assert [r.cover_weeks for r in got] == values  # covers stay as they are
    legacy = fix_decimal_percent(df, ["cover_weeks"]).orderBy("i").collect()
    assert [r.cover_weeks for r in legacy] == pytest.approx(want)


def test_percent_fixer_decides_per_dataset(spark):
    df = spark.createDataFrame([("a", 0.3, 0.1), ("a", 0.4, 50.0), ("b", 30.0, 0.2)], "dataset_id string, margin_pct double, sell_through double")
    got = {(r.dataset_id, r.margin_pct, r.sell_through) for r in fix_decimal_percent(df).collect()}
    assert got == {("a", 30.0, 0.1), ("a", 40.0, 50.0), ("b", 30.0, 20.0)}


def test_gbp_compact(spark):
    cases = {0.0: "£0", 567.4: "£567", 1000.0: "£1k", 34499.0: "£34k", 1.25e6: "£1.2m", 2.5e6: "£2.5m", -12345.0: "£-12k", 999.6: "£1,000"}
    df = spark.createDataFrame([(k,) for k in cases], "v double").withColumn("t", gbp_compact(F.col("v")))
    assert {r.v: r.t for r in df.collect()} == cases


def test_truthiness_and_rounding(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.5,), (3.5,)], "v double").select(
        or_default(F.col("v"), 3.0).alias("d"), whole(F.col("v")).alias("w"), safe_float(F.col("v")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [(3.0, 0, 0.0), (3.0, None, 0.0), (2.5, 2, 2.5), (3.5, 4, 3.5)]
