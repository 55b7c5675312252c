"""Billing across runs: stored customers, late and repeated deliveries."""

import datetime as dt

import pytest

from tradeloom.streaming import billing

SCHEMA = "id string, type string, ts timestamp, customer string, price_id string, reference_id string, email string, status string"


def event(i, kind, hour, customer="cus_1", price="price_starter", reference=None, status="active"):
    types = {"buy": billing.CHECKOUT, "update": billing.UPDATED, "delete": billing.DELETED}
    return (f"evt_{i}", types[kind], dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), customer, price, reference, None, status)


def folded(spark, events, profiles):
    people = spark.createDataFrame(profiles, "user_id string, email string, plan string, customer string")
    return {r.user_id: (r.plan, r.customer) for r in billing.plan_fold(spark.createDataFrame(events, SCHEMA), people).collect()}


def test_customers_stored_earlier(spark):
    profiles = [("a", None, "growth", "cus_1"), ("b", None, "starter", "cus_2"), ("c", None, "growth", "cus_3"), ("d", None, "trial", None)]
    events = [event(1, "delete", 5), event(2, "update", 1, "cus_2", "price_studio"), event(3, "buy", 3, "cus_9", "price_growth", "d"), event(4, "update", 2, "cus_9", "price_studio")]
    assert folded(spark, events, profiles) == {"a": ("trial", "cus_1"), "b": ("studio", "cus_2"), "c": ("growth", "cus_3"), "d": ("growth", "cus_9")}


EVENTS = [event(1, "update", 9, "cus_5", "price_studio"), event(2, "buy", 4, "cus_5", "price_growth", "b"), event(3, "delete", 2), event(4, "update", 3, "cus_1", "price_starter"), event(1, "update", 9, "cus_5", "price_studio")]


def test_batches_give_what_one_run_gives(spark, tmp_path):
    profiles = [("a", "a@x.com", "growth", "cus_1"), ("b", "b@x.com", "trial", None)]
    people = spark.createDataFrame(profiles, "user_id string, email string, plan string, customer string")
    fold = billing.PlanFold(str(tmp_path / "fold"), people)
    seen = lambda f: {r.user_id: (r.plan, r.customer) for r in f.plans(spark).collect()}
    assert seen(fold) == {"a": ("growth", "cus_1"), "b": ("trial", None)}
    for n, e in enumerate([*EVENTS, EVENTS[2]]):
        batch = spark.createDataFrame([e], SCHEMA)
        for _ in range(2):  # a replayed batch changes nothing
            fold(batch, n)
    want = folded(spark, EVENTS, profiles)
    assert seen(fold) == want == {"a": ("starter", "cus_1"), "b": ("studio", "cus_5")}
    assert seen(billing.PlanFold(str(tmp_path / "fold"), people)) == want  # a new driver, before any new batch


def test_compaction_keeps_the_plans(spark, tmp_path):
    profiles = [("a", "a@x.com", "growth", "cus_1"), ("b", "b@x.com", "trial", None)]
    people = spark.createDataFrame(profiles, "user_id string, email string, plan string, customer string")
    fold = billing.PlanFold(str(tmp_path / "fold"), people)
    seen = lambda: {r.user_id: (r.plan, r.customer) for r in fold.plans(spark).collect()}
    sizes = []
    for n, e in enumerate(EVENTS):
        fold(spark.createDataFrame([e], SCHEMA), n)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "fold" / "deltas" / f"batch={n}").rglob("*.parquet")) if (tmp_path / "fold" / "deltas" / f"batch={n}").exists() else 0)
        if n in (1, 2):
            fold.compact(spark, n)
    assert seen() == folded(spark, EVENTS, profiles) and max(sizes) < 3 * min(sizes)
    assert sorted(f.name for f in (tmp_path / "fold" / "sums").iterdir()) == ["through=2"]
    assert sorted(f.name for f in (tmp_path / "fold" / "deltas").iterdir()) == ["batch=3", "batch=4"]
    (tmp_path / "fold" / "sums" / "through=4" / "checkouts").mkdir(parents=True)  # one that never ended
    assert seen() == folded(spark, EVENTS, profiles)


def deduplicated(spark, tmp_path, fail_at=None):
    """Runs the stream over what lies in the folder; a failing batch ends the run."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA + ", delivery int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def write(batch, n):
        if n == fail_at:
            raise ValueError("sink is down")
        billing.billing_sink(str(tmp_path / "out"))(batch, n)

    run = billing.billing_dedup_stream(stream).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    if fail_at is None:
        run.awaitTermination()
    else:
        with pytest.raises(Exception):
            run.awaitTermination()
    return sorted((r.id, r.delivery) for r in spark.read.schema(SCHEMA + ", delivery int").parquet(str(tmp_path / "out")).collect())


def test_events_count_once_over_batches_failures_and_restarts(spark, tmp_path):
    deliver = lambda n, rows: spark.createDataFrame([(*e, k) for e, k in rows], SCHEMA + ", delivery int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    deliver(0, [(EVENTS[0], 2), (EVENTS[0], 1), (EVENTS[1], 1)])
    assert deduplicated(spark, tmp_path) == [("evt_1", 1), ("evt_2", 1)]
    deliver(1, [(EVENTS[2], 1), (EVENTS[1], 2)])
    assert deduplicated(spark, tmp_path, fail_at=1) == [("evt_1", 1), ("evt_2", 1)]
    assert deduplicated(spark, tmp_path) == [("evt_1", 1), ("evt_2", 1), ("evt_3", 1)]  # taken again by a new run
    deliver(2, [(EVENTS[4], 3), (EVENTS[3], 1), (EVENTS[2], 2)])
    assert deduplicated(spark, tmp_path) == [("evt_1", 1), ("evt_2", 1), ("evt_3", 1), ("evt_4", 1)]


def test_many_ids_of_a_batch_pass_in_few_calls(spark):
    """A call of Python for every id takes milliseconds each, which no number of events can afford."""
    stream = spark.readStream.format("rate").load().selectExpr("cast(value as string) AS id", "timestamp AS ts")
    text = billing.billing_dedup_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in text and "TransformWithState" not in text


def test_first_delivery_of_a_batch_counts_whatever_the_order(spark, tmp_path):
    rows = [(*event(i, "buy", h), k) for h, k in ((5, 1), (2, 3), (2, 2), (9, 1)) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA + ", delivery int").coalesce(1).write.parquet(str(tmp_path / "in"))
    assert deduplicated(spark, tmp_path) == sorted((f"evt_{i}", 2) for i in range(300))
