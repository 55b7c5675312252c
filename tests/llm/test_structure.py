import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tradeloom.llm import query_structure, structure

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(kinds):
    """(cost, audit) by trying all edits of one conversation, from the grammar as a pattern: shortest
    paths over (row, last role, rows so far), all with the same cost compared as texts."""
    best = {(0, ""): (0, "")}
    done = {}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    while best:
        (i, last), (cost, audit) = min(best.items(), key=lambda x: (x[1], x[0]))
        del best[i, last]
        done[i, last] = cost, audit
        if i == len(kinds) and last in ("", "a"):
            return cost, audit
        moves = [(i, wanted[last], 2, "I")]
        if i < len(kinds):
            initial, fault = kinds[i]
            late = fault == "t"
            moves.append((i + 1, last, 3, "D"))
            if fault not in ("b", "d"):
                moves.append((i + 1, wanted[last], 2 + late, "R"))
                if initial == wanted[last] or initial == "s" and last == "":
                    moves.append((i + 1, initial, late, "K"))
        for j, role, price, edit in moves:
            new = cost + price, audit + edit
            if (j, role) not in done and new < best.get((j, role), (1 << 60, "")):
                best[j, role] = new


def test_all_short_signatures():
    symbols = "suaoSUAOx"
    every = sorted(("".join(c) for n in range(6) for c in itertools.product(symbols, repeat=n)), key=lambda s: s[::-1])
    kinds = lambda s: [("?", "b") if c == "x" else (c.lower(), "t" if c.isupper() else "") for c in s]
    r = random.Random(3)
    for signature, weight, cost, audit in structure.solve_sorted((s, len(s)) for s in every):
        assert weight == len(signature)
        if len(signature) < 4 or r.random() < 0.05:
            assert (cost, audit) == cheapest(kinds(signature)), signature


def brute(rows):
    """The contract, row by row, of (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held[conv]
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        role = "user" if code == 4 else role
        held[conv] += [(turn, role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, given in held.items():
        given.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in given:
            last = text.rstrip(BLANKS)[-1:]
            kinds.append((role[:1], "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in given if t is not None]
        cost, audit = cheapest(kinds)
        lines, left, last = [], iter(given), ""
        for edit in audit:
            _, role, text = ("", "", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        count = lambda f: sum(k[1] == f for k in kinds)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "?", "?", None) for r in rows], "conv_id long, turn long, role string, text string, key long, conv string, signature string, audit string")
    got = structure.repair(query_structure.damaged(frame)).collect()
    assert len({r["conv"] for r in got}) == len(got)
    return {r["conv"]: tuple(r[c] for c in COLUMNS) for r in got}


def invented(n, seed=1):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.choice([0, 1, 2, 5, 8, 40])):
            role = r.choice(["user", "assistant", "assistant", "system", "tool", "", "User", None])
            text = r.choice(["Yes.", "No", " \t\r\n", "", None, "Why?\n", "é. ", "so\x85", f"number {turn}!", "\x1f"])
            rows.append((conv, r.choice([turn, turn, turn + 3, None, 2]), role, text))
    return rows


def test_against_brute_force(spark):
    rows = [*invented(150), *[(None, t, "user", "a.") for t in range(4)], (900, 1, "user", "x" * 200_000 + "."), (901, None, None, None), *[(902, 7, "user", "same.")] * 5,
            *[(903, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)], (904, -(1 << 63), "user", "a."), (904, (1 << 63) - 1, "user", "b.")]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        if conv != 904:
            assert got[conv] == want[conv], conv
    assert got[904][0] is None and got[904][1:] == want[904][1:]


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_sql_on_odd_rows(spark, tmp_path):
    rows = [*invented(60, 2), *[(None, t, "user", "a.") for t in range(4)], *[(902, 7, "user", "same.")] * 5]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = con.sql(query_structure._SQL)
    got = {r[0]: r[1:] for r in found.select(*[duckdb.ColumnExpression(c) for c in ("conv_id", *COLUMNS)]).fetchall()}
    assert got == brute(rows)


def test_many_signatures_beyond_the_broadcast(spark, monkeypatch):
    plain = structure.looked_up
    monkeypatch.setattr(structure, "looked_up", lambda a, b, k, w: plain(a, b, k, w, max_hot=5))
    rows = invented(120, 4)
    assert run(spark, rows) == brute(rows)


def test_one_shuffle_before_the_measures(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a.", False)], "conv long, turn long, role string, text string, gone boolean")
    plan = structure.measured(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
