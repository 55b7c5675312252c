"""Account lockout: five failures in a row lock an account for a while.

One step function serves both forms. The stream keeps one small state per account. The
batch form cuts the attempts into range slices ordered by (account, time), so an account
with very many attempts is spread over many tasks; see ``lockout_batch``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.operators.ordering import SLICE, sliced
from tradeloom.staging import staged

# Failures before a lock, seconds of a lock, delay steps in seconds.
MAX_FAILS, LOCK_SECONDS, BASE_DELAY, MAX_DELAY = 5, 900, 0.5, 5.0
SECOND = 1_000_000
ROWS_PER_SLICE = 1_000_000
OUTPUT = "account string, ts_us bigint, attempt_id bigint, status string, fails int, locked boolean, delay double"
CLEAR = (0, 0, 0)
_FUNCTION = {"relative": "array<boolean>", "fails": "array<bigint>", "lasts": "array<bigint>", "until": "array<bigint>", "direct": "array<int>", "near": "array<bigint>",
             "behind": "array<int>", "same": "array<int>", "end": "bigint", "lock": "bigint"}
_TRANSITION = f"account string, {SLICE} int, state array<bigint>, " + ", ".join(f"{k} {v}" for k, v in _FUNCTION.items())


def account_key(email: Column) -> Column:
    """Key of an account: hash of the trimmed, lower-cased address."""
    return F.sha2(F.lower(F.trim(F.coalesce(email, F.lit("")))), 256)


def delay_after(fails: int) -> float:
    return min(BASE_DELAY * 2 ** (fails - 1), MAX_DELAY) if fails > 0 else 0.0


def step(state: tuple, now: int, success: bool, lock_us: int) -> tuple[tuple, str, bool]:
    """New state, outcome and whether this attempt locked the account.

    State is (failures in a row, time of the last one, end of the lock), times in
    microseconds.
    """
    fails, last, until = state
    if fails and until > now:
        return state, "BLOCKED", False
    if fails and now - last > lock_us:
        fails = 0
    if success:
        return CLEAR, "SUCCESS", False
    fails += 1
    locked = fails >= MAX_FAILS
    return (fails, now, now + lock_us if locked else 0), "FAILURE", locked


def walk(rows: pd.DataFrame, entry: tuple, lock_us: int) -> tuple[list, tuple]:
    """Outcomes of a slice in order, and the state its last account ends in."""
    out, account, state = [], None, entry
    for name, now, attempt, success in zip(rows["account"], rows["ts_us"], rows["attempt_id"], rows["success"]):
        if name != account:
            state = entry if account is None else CLEAR
            account = name
        state, status, locked = step(state, now, success, lock_us)
        delay = 0.0 if status == "SUCCESS" else delay_after(state[0])
        out.append((name, now, attempt, status, state[0], locked, delay))
    return out, state


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["account", "ts_us", "attempt_id"], kind="stable")


def lockout_batch(attempts: DataFrame, lock_seconds: int = LOCK_SECONDS, slices: int | None = None) -> DataFrame:
    """Outcome of every attempt: SUCCESS, FAILURE or BLOCKED.

    A slice needs to know in which state the account it starts with left the slice before. Where
    an account fills a slice, the slice is summed up as a function from the state it is entered in
    to the state it is left in (see ``Transition``), and the functions of an account are composed in order.
    That takes the same few jobs however many slices an account fills; every slice is
    sorted once for its function and once for its outcomes. The driver sees one state per slice,
    never attempts.
    """
    lock_us = lock_seconds * SECOND
    shaped = attempts.select("account", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "attempt_id", "success")
    slices = slices or max(1, math.ceil(shaped.count() / ROWS_PER_SLICE), int(shaped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = sliced(shaped, ["account"], [F.col("ts_us"), F.col("attempt_id")], "lockout", slices)
    edges = {r[SLICE]: (r["first"], r["last"]) for r in parts.groupBy(SLICE).agg(
        F.min("account").alias("first"), F.max("account").alias("last")).collect()}
    order = sorted(edges)
    follower = {a: b for a, b in zip(order, order[1:]) if edges[a][1] == edges[b][0]}
    entered = {b for a, b in follower.items() if edges[b][0] == edges[b][1]}
    left = parts.where(F.col(SLICE).isin(list(follower))).groupBy(SLICE).applyInPandas(transitions(entered, lock_us), _TRANSITION)
    dealt = staged(left, "lockout-transitions").repartition("account").sortWithinPartitions("account", SLICE)
    entry = {follower[r[SLICE]]: (r["fails"], r["last"], r["until"]) for r in dealt.mapInPandas(composed, f"{SLICE} int, fails bigint, last bigint, until bigint").collect()}
    return parts.groupBy(SLICE).applyInPandas(outcomes(entry, lock_us), OUTPUT).withColumn(
        "ts", F.timestamp_micros("ts_us")).drop("ts_us")


class Transition:
    """How one account's attempts in a slice change its state, for every state before.

    An account that isn't locked enters with a count of 0 to 4 at the first attempt. One that
    is locked waits for the first attempt at or behind the lock's end and, behind it, starts from 0 there;
    a lock ends at most its length behind the slice's start, so only the attempts up to then
    come into question. An attempt exactly at the end goes on counting, from any count the lock
    has. Paths through the attempts that meet stay together, so each (attempt, count) is followed once.
    """

    def __init__(self, ts: np.ndarray, success: np.ndarray, lock_us: int):
        self.ts, self.success, self.lock, self.n = ts, success, lock_us, len(ts)
        self.known: dict[tuple[int, int], int] = {}
        self.ids: dict[tuple, int] = {}
        self.exits: list[tuple] = []

    def exit_id(self, *state) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.exits)
            self.exits.append(state)
        return self.ids[state]

    def follow(self, j: int, count: int) -> int:
        """Exit when attempt j is met with ``count`` failures in a row; a count of 5 stands for any
        that goes on behind an expired lock, and the exit tells how many to add."""
        path, more, found = [], 0, None
        while found is None:
            if (j, count) in self.known and not more:
                found = self.known[j, count]
                break
            if not more:
                path.append((j, count))
            now = int(self.ts[j])
            if self.success[j]:
                j, count, more = j + 1, 0, 0
                found = self.exit_id(False, *CLEAR) if j == self.n else None
            elif count + 1 < MAX_FAILS:
                if j + 1 == self.n:
                    found = self.exit_id(False, count + 1, now, 0)
                else:
                    count = 0 if self.ts[j + 1] - now > self.lock else count + 1
                    j += 1
            else:
                more += count == MAX_FAILS
                relative = more > 0
                until = now + self.lock
                j = int(np.searchsorted(self.ts, until))
                if j >= self.n:
                    found = self.exit_id(relative, more if relative else MAX_FAILS, now, until)
                elif self.ts[j] > until:
                    count, more = 0, 0
                elif not relative:
                    # A lock made here, followed by an attempt at its very end: a plain walk from there.
                    found = self.locked_at(j)
                else:
                    count = MAX_FAILS
        for key in path:
            self.known[key] = found
        return found

    def locked_at(self, j: int) -> int:
        """Exit behind a lock of five failures whose end is the time of attempt j."""
        relative, fails, last, until = self.exits[self.follow(j, MAX_FAILS)]
        return self.exit_id(False, fails + MAX_FAILS if relative else fails, last, until)

    def table(self) -> dict[str, list]:
        """What ``apply`` needs, as columns."""
        last = int(self.ts[-1])
        near = min(self.n, int(np.searchsorted(self.ts, self.ts[0] + self.lock, "right")) + 1)
        direct = [self.follow(0, c) for c in range(MAX_FAILS)]
        behind, same = [], []
        for j in range(near):
            behind.append(self.follow(j, 0))
            same.append(self.follow(j, MAX_FAILS))
        relative, fails, lasts, until = zip(*self.exits)
        return {"relative": list(relative), "fails": list(fails), "lasts": list(lasts), "until": list(until), "direct": direct,
                "near": self.ts[:near].tolist(), "behind": behind, "same": same, "end": last, "lock": self.lock}


def applied(t: dict, state: tuple) -> tuple:
    """The state behind a slice that is entered in ``state``."""
    fails, last, until = state
    first = t["near"][0]
    if fails >= MAX_FAILS and until >= first:
        if until > t["end"]:
            return state
        j = bisect.bisect_left(t["near"], until)
        i = t["same"][j] if t["near"][j] == until else t["behind"][j]
    else:
        i = t["direct"][0 if not fails or first - last > t["lock"] else fails]
    return (t["fails"][i] + (fails if t["relative"][i] else 0), t["lasts"][i], t["until"][i])


def transitions(entered: set, lock_us: int):
    """Per slice, how its last account leaves it: a state, or a function of the one it enters with."""
    def of_slice(rows: pd.DataFrame) -> pd.DataFrame:
        number, account = int(rows[SLICE].iloc[0]), rows["account"].max()
        rows = in_order(rows[rows["account"] == account])
        out = dict.fromkeys(_FUNCTION, None) | {"account": account, SLICE: number, "state": None}
        if number in entered:
            out |= Transition(rows["ts_us"].to_numpy(), rows["success"].to_numpy(dtype=bool), lock_us).table()
        else:
            out["state"] = list(walk(rows, CLEAR, lock_us)[1])
        return pd.DataFrame({k: [v] for k, v in out.items()})
    return of_slice


def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each slice is left in, for slices that come in order of account and number."""
    state = CLEAR
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            if row["state"] is not None:
                state = tuple(int(v) for v in row["state"])
            else:
                state = applied({k: row[k] for k in _FUNCTION}, state)
            out.append((row[SLICE], *map(int, state)))
        yield pd.DataFrame(out, columns=[SLICE, "fails", "last", "until"])


def outcomes(entry: dict, lock_us: int):
    """Per slice, the outcome of every attempt."""
    def of_slice(rows: pd.DataFrame) -> pd.DataFrame:
        done, _ = walk(in_order(rows), entry.get(int(rows[SLICE].iloc[0]), CLEAR), lock_us)
        return pd.DataFrame(done, columns=["account", "ts_us", "attempt_id", "status", "fails", "locked", "delay"])
    return of_slice


def lockout_stream(attempts: DataFrame, lock_seconds: int = LOCK_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same outcomes over a stream of attempts, one small state per account.

    Attempts wait in the state until the watermark has passed them and are then walked in
    order, so one that arrives a batch late, but within ``late``, is judged in its place. An
    account's state is dropped once a lock and the decay of its counter have both passed in
    silence.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    lock_us = lock_seconds * SECOND

    class Lockout(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("lock", "fails bigint, last bigint, until bigint")
            self.waiting = handle.getListState("attempts", "ts_us bigint, attempt_id bigint, success boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                self.waiting.appendList([(int(t), int(i), bool(s)) for t, i, s in zip(pdf["ts_us"], pdf["attempt_id"], pdf["success"])])
                self.handle.registerTimer(int(pdf["ts_us"].min()) // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
            ready, rest = [x for x in held if x[0] < passed], [x for x in held if x[0] >= passed]
            entry = tuple(int(v) for v in self.state.get()) if self.state.exists() else CLEAR
            if ready:
                rows = pd.DataFrame(ready, columns=["ts_us", "attempt_id", "success"]).assign(account=key[0])
                done, entry = walk(rows, entry, lock_us)
                yield pd.DataFrame(done, columns=["account", "ts_us", "attempt_id", "status", "fails", "locked", "delay"])
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            elif held:
                self.waiting.clear()
            if entry == CLEAR or not rest and entry[1] + 2 * lock_us < passed:
                self.state.clear()
            else:
                self.state.update(entry)
                self.handle.registerTimer((entry[1] + 2 * lock_us) // 1000 + 1)

        def close(self) -> None:
            pass

    stamped = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    shaped = stamped.select("account", "ts", F.unix_micros("ts").alias("ts_us"), "attempt_id", "success")
    return shaped.groupBy("account").transformWithStateInPandas(
        statefulProcessor=Lockout(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def failure_episodes(attempts: DataFrame, gap_seconds: int = LOCK_SECONDS) -> DataFrame:
    """Episodes of failures per account: a pause longer than the gap ends one.

    Failures inside one clock slot of gap length always belong together, so they are
    counted per slot first. What the window then sorts per account is one row per slot:
    bounded by the time span, not by the number of failures.
    """
    from pyspark.sql import Window

    fails = attempts.where(~F.col("success")).select("account", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slot = F.floor(F.col("us") / F.lit(gap_seconds * SECOND))
    slots = fails.groupBy("account", slot.alias("slot")).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
    by_time = Window.partitionBy("account").orderBy("slot")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(by_time)) > gap_seconds * SECOND, F.lit(True))
    marked = slots.withColumn("fresh", fresh.cast("int")).withColumn("episode", F.sum("fresh").over(by_time))
    return marked.groupBy("account", "episode").agg(
        F.timestamp_micros(F.min("first")).alias("started"), F.timestamp_micros(F.max("last")).alias("ended"), F.sum("n").alias("failures"))


def failure_episodes_stream(attempts: DataFrame, gap_seconds: int = LOCK_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming form with session windows (a pause of exactly the gap ends the session)."""
    fails = attempts.where(~F.col("success")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    session = F.session_window("ts", f"{gap_seconds} seconds")
    return fails.groupBy("account", session.alias("w")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("failures")).drop("w")
