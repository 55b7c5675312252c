import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.streaming import lockout

START = dt.datetime(2024, 1, 1)


def attempts(spark, rows):
    return spark.createDataFrame([(a, START + dt.timedelta(seconds=s), i, ok) for i, (a, s, ok) in enumerate(rows)],
                                 "account string, ts timestamp, attempt_id bigint, success boolean")


def brute_force(rows, lock=900):
    """Plain dictionary of account states, attempt by attempt."""
    books, out = {}, {}
    for i, (a, s, ok) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        e = books.get(a)
        if e and e["until"] > s:
            out[i] = "BLOCKED"
            continue
        if e and s - e["ts"] > lock:
            books.pop(a)
        if ok:
            books.pop(a, None)
            out[i] = "SUCCESS"
            continue
        e = books.setdefault(a, {"n": 0, "until": 0, "ts": s})
        e["n"], e["ts"] = e["n"] + 1, s
        if e["n"] >= 5:
            e["until"] = s + lock
        out[i] = "FAILURE"
    return out


def test_documented_sequence(spark):
    m = 60
    rows = [("a", i * m, False) for i in range(5)] + [("a", 10 * m, True), ("a", 20 * m, False), ("a", 21 * m, True), ("a", 22 * m, False), ("a", 38 * m, False)]
    got = {r.attempt_id: r for r in lockout.lockout_batch(attempts(spark, rows)).collect()}
    assert [got[i].status for i in range(10)] == ["FAILURE"] * 5 + ["BLOCKED", "FAILURE", "SUCCESS", "FAILURE", "FAILURE"]
    assert [got[i].fails for i in (4, 6, 8, 9)] == [5, 1, 1, 1] and got[4].locked and not got[3].locked
    assert [got[i].delay for i in range(5)] == [0.5, 1.0, 2.0, 4.0, 5.0]


def test_expiry_on_the_second_locks_again(spark):
    rows = [("a", i, False) for i in range(5)] + [("a", 4 + 900, False)]
    got = {r.attempt_id: r for r in lockout.lockout_batch(attempts(spark, rows)).collect()}
    assert (got[5].status, got[5].fails, got[5].locked) == ("FAILURE", 6, True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_account_over_many_slices(spark, seed):
    rng = random.Random(seed)
    rows, clock = [], 0
    for _ in range(3000):
        clock += rng.choice([1, 5, 30, 200, 1000] if seed != 3 else [3])
        rows.append((rng.choice(["hot", "hot", "b", "c"]) if seed != 3 else "hot", clock, rng.random() < (0.02 if seed != 3 else 0)))
    got = {r.attempt_id: r.status for r in lockout.lockout_batch(attempts(spark, rows), slices=12).collect()}
    assert got == brute_force(rows)


def test_a_slice_as_a_function_of_its_entry():
    """Any attempts, any state before: the function gives what a walk gives."""
    rng = random.Random(11)
    for _ in range(3000):
        lock, clock, times = rng.choice([4, 10, 30]), rng.randint(1, 50), []
        for _ in range(rng.randint(1, 25)):
            clock += rng.choice([0, 1, 1, 2, lock, lock + 1, lock // 2])
            times.append(clock)
        ok = [rng.random() < rng.choice([0, 0, 0.2]) for _ in times]
        table = lockout.Transition(np.array(times, dtype=np.int64), np.array(ok), lock).table()
        for _ in range(12):
            last = times[0] - rng.choice([0, 1, lock - 1, lock, lock + 1, 2 * lock])
            fails = rng.choice([0, 1, 2, 3, 4, 5, 6, 9])
            state = (fails, last, last + lock if fails >= 5 else 0) if fails else lockout.CLEAR
            want = state
            for t, success in zip(times, ok):
                want, _, _ = lockout.step(want, t, success, lock)
            assert lockout.applied(table, state) == want, (times, ok, lock, state)


def jobs(spark, work):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup("lockout-jobs")
    spark.sparkContext.setJobGroup("lockout-jobs", "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("lockout-jobs")) - len(before)


def test_jobs_do_not_grow_with_slices(spark):
    """One account that never pauses, over 4 and over 60 slices."""
    rows = [("hot", 3 * i, False) for i in range(6000)]
    frame = attempts(spark, rows)
    few, n_few = jobs(spark, lambda: {r.attempt_id: r.status for r in lockout.lockout_batch(frame, slices=4).collect()})
    many, n_many = jobs(spark, lambda: {r.attempt_id: r.status for r in lockout.lockout_batch(frame, slices=60).collect()})
    assert few == many == brute_force(rows) and abs(n_many - n_few) <= 1


def test_episodes(spark):
    rows = [("a", 0, False), ("a", 900, False), ("a", 1801, False), ("a", 1900, True), ("b", 5, False), ("b", 9000, False)]
    got = {(r.account, r.started, r.failures) for r in lockout.failure_episodes(attempts(spark, rows)).collect()}
    t = lambda s: START + dt.timedelta(seconds=s)
    assert got == {("a", t(0), 2), ("a", t(1801), 1), ("b", t(5), 1), ("b", t(9000), 1)}


def test_account_key(spark):
    df = spark.createDataFrame([(" Ann@X.com ",), ("ann@x.com",), (None,)], "e string").select(lockout.account_key(F.col("e")).alias("k"))
    a, b, c = [r.k for r in df.collect()]
    assert a == b != c


def test_stream_orders_attempts_that_arrive_late(spark, tmp_path):
    """Three batches out of order; all rows the watermark has passed are judged as in one run."""
    rng = random.Random(7)
    rows, clock = [], 0
    for _ in range(400):
        clock += rng.choice([1, 5, 20])
        rows.append((rng.choice("abc"), clock, rng.random() < 0.1))
    rows.append(("z", clock + 100_000, True))
    frame = attempts(spark, rows)
    for n, part in enumerate([F.col("attempt_id") % 3 == 2, F.col("attempt_id") % 3 == 0, F.col("attempt_id") % 3 == 1]):
        frame.where(part & (F.col("account") != "z")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    frame.where("account = 'z'").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = lockout.lockout_stream(stream, late="3 hours")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {r.attempt_id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = brute_force(rows)
    want.pop(len(rows) - 1)
    assert got == want
