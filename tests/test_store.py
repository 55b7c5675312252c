"""Publishing sheet by sheet gives what one run over all lines gives."""

import glob
import random

import pytest

from tradeloom.plans.book import AnalysisBook
from tradeloom.sources import store


def sheet(make_lines, dataset, name, seed, first=0):
    from pyspark.sql import functions as F

    r = random.Random(seed)
    pick = lambda options: r.choice(options)
    rows = [{"dataset_id": dataset, "row_id": first + i, "sku": pick(["a", "b", "c", None]), "units": r.randint(0, 9), "revenue": r.randint(0, 500), "stock": pick([0, 5, 30]),
             "margin_pct": pick([None, 12.5, 33.3]), "sell_through": pick([10, 55.5, 90]), "cover_weeks": pick([0.5, 3, 20]), "category": pick([None, "x", "y"]), "channel": pick([None, "web", "shop"]),
             "week": pick([None, "1", "2"]), "name": pick([None, "n", "m"]), "brand": "z", "cost": 2, "retail": 5, "margin_value": 1, "buy_qty": pick([None, 4]), "full_price_sales": 3} for i in range(20)]
    return make_lines(rows, {"stock", "margin_pct", "sell_through", "cover_weeks", "category", "channel", "week", "name", "brand", "cost", "retail", "margin_value", "buy_qty", "full_price_sales"}).withColumn("sheet", F.lit(name))


def contents(tables):
    return {k: sorted((sorted(r.asDict().items()) for r in df.collect()), key=str) for k, df in tables.items()}


def whole(*sheets):
    lines = sheets[0]
    for s in sheets[1:]:
        lines = lines.unionByName(s)
    return contents(AnalysisBook(lines.drop("sheet")).tables())


def test_steps_give_what_one_run_gives(spark, tmp_path, make_lines):
    shop = store.AnalysisStore(spark, str(tmp_path / "shop"))
    a1, a2, b1 = sheet(make_lines, "A", "one", 1), sheet(make_lines, "A", "two", 2, 100), sheet(make_lines, "B", "one", 3)
    a1_new = sheet(make_lines, "A", "one", 5)
    shop.publish(a1.unionByName(b1))
    shop.publish(a2)
    before = shop.tables()
    shop.publish(a1_new)
    assert contents(shop.tables()) == whole(a1_new, a2, b1)
    assert contents(before) == whole(a1, a2, b1)  # a reader that began earlier sees one state
    shop.publish(a1_new.limit(0), spark.createDataFrame([("A", "two"), ("B", "one")], "dataset_id string, sheet string"))
    assert {(r.dataset_id, r.sheet) for r in shop.manifest().collect()} == {("A", "one"), ("B", None)}
    shop.compact()
    shop.vacuum()
    assert len(shop.versions()) == 1 and contents(shop.tables()) == whole(a1_new)
    shop.publish(b1)
    assert contents(shop.tables()) == whole(a1_new, b1)


def test_only_touched_datasets_are_written_and_read(spark, tmp_path, make_lines):
    shop = store.AnalysisStore(spark, str(tmp_path / "shop"))
    a, b = sheet(make_lines, "A", "one", 1), sheet(make_lines, "B", "one", 2)
    first, second = shop.publish(a), shop.publish(b)
    for kind in ("partials/skus", "tables/sku_rollup", "manifest"):
        held = lambda v: {r.dataset_id for r in spark.read.parquet(f"{tmp_path}/shop/{kind}/v={v}").collect()}
        assert held(first) == {"A"} and held(second) == {"B"}
    third = shop.publish(sheet(make_lines, "B", "two", 3, 100))
    # A's partials are gone, and B can still be published.
    import os
    for path in glob.glob(f"{tmp_path}/shop/partials/*/v={first}/*.parquet"):
        os.truncate(path, 0)
    assert shop.publish(sheet(make_lines, "B", "two", 4, 100)) == third + 1


def test_half_a_publish_is_not_seen(spark, tmp_path, make_lines, monkeypatch):
    shop = store.AnalysisStore(spark, str(tmp_path / "shop"))
    with pytest.raises(FileNotFoundError):
        shop.table("kpis")
    a, changed = sheet(make_lines, "A", "one", 1), sheet(make_lines, "A", "one", 2)
    shop.publish(a)
    write = store.AnalysisStore._write

    def fails(self, rows, place, keys):
        if place.startswith("manifest"):
            raise OSError("lost")
        write(self, rows, place, keys)

    monkeypatch.setattr(store.AnalysisStore, "_write", fails)
    with pytest.raises(OSError):
        shop.publish(changed)
    assert contents(shop.tables()) == whole(a)
    monkeypatch.setattr(store.AnalysisStore, "_write", write)
    shop.publish(changed)
    assert contents(shop.tables()) == whole(changed)


def plan(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_sku_rows_are_moved_once_and_lie_as_they_are_written(make_lines, monkeypatch):
    lines = sheet(make_lines, "A", "one", 1)
    for _ in range(2):
        parts = store.partial_rollup(lines)
        for rows in (parts, store.merged_rollup(parts)):
            text = plan(rows.sortWithinPartitions("dataset_id", "sku"))
            assert "rangepartitioning(dataset_id" in text and "hashpartitioning" not in text
        monkeypatch.setattr(store, "HOT_LINES", 2)


def test_a_hot_sku_is_summed_up_in_slices(make_lines, monkeypatch):
    from pyspark.sql import functions as F

    from tradeloom.operators.rollup import sku_rollup

    rows = [{"sku": "hot" if i % 3 else f"s{i}", "row_id": i, "revenue": i, "stock": i, "name": str(i)} for i in range(300)]
    lines = make_lines(rows).withColumn("sheet", F.lit("one"))
    got = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = got(sku_rollup(lines.drop("sheet")))
    assert store.partial_rollup(lines).count() == len(want) == 101
    monkeypatch.setattr(store, "HOT_LINES", 50)
    parts = store.partial_rollup(lines)
    assert parts.where("sku = 'hot'").count() > 10 and parts.count() - parts.where("sku = 'hot'").count() == 100
    assert got(store.merged_rollup(parts)) == want


def test_publish_leaves_no_shuffle_files(spark, tmp_path, make_lines):
    import time

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {p for top in folders for p in glob.glob(f"{top}/*/shuffle_*.data")}
    before, shop = held(), store.AnalysisStore(spark, str(tmp_path / "shop"))
    was = spark.conf.get(setting)
    shop.publish(sheet(make_lines, "A", "one", 1).unionByName(sheet(make_lines, "B", "one", 2)))
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(setting) == was
    assert not glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/tradeloom/*/merged-rollup-*")
