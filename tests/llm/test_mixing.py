import hashlib
import random
from collections import defaultdict

import pytest

from tradeloom.llm import mixing
from tradeloom.staging import staged


def rows_of(n, seed=5):
    r = random.Random(seed)
    names = ["a"] * 10 + ["b", "c", "B", None, "é", "d"]
    return [(i, "w " * r.choice([0, 1, 5, 30, r.randrange(400)]), r.choice(names)) for i in range(n)]


def brute(rows, most=3):
    sizes, h = defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        h[i] = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(weight[s] for s in order if s not in capped)
        level = (sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / rest if rest else 0.0
        new = {s for s in order if s not in capped and weight[s] * level > most * sizes[s]}
        if not new:
            break
        capped |= new
    target = {s: float(most * sizes[s]) if s in capped else weight[s] * level for s in order}
    out = []
    for s in order:
        mine = sorted((h[i], len((t or "").split()), i) for i, t, x in rows if x == s)
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, upto, pieces = target[s] - whole * sizes[s], 0, defaultdict(int)
        for x, n, _ in mine:
            pieces[x] += n
        last = -1
        for x in sorted(pieces):
            if pieces[x] and upto + pieces[x] / 2 <= budget:
                last = x
            upto += pieces[x]
        out += [(i, n, sizes[s], round(target[s], 6), n * (whole + (x <= last))) for x, n, i in mine]
    return sorted(out, key=str)


def result(docs):
    return sorted(((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix_sources(docs).collect()), key=str)


def test_brute_force(documents):
    rows = [*rows_of(300), (7, "repeated id", "a"), (7, "repeated id", "a"), (None, "no id", "a"), (901, None, "b"), (902, "", "empty source"), (903, "long " * 30000, "b")]
    got = result(documents(rows))
    assert got == brute(rows)
    assert all(r[4] <= 3 * r[1] for r in got) and result(documents(rows)) == got


@pytest.mark.parametrize("finish", [0, 3])
def test_every_step_of_the_refinement(documents, finish):
    rows = rows_of(120)
    sized = staged(mixing.sized(documents(rows)), "rows")
    limits = mixing.thresholds(sized, mixing.targets(sized), rows_to_finish=finish)
    usual = mixing.thresholds(sized, mixing.targets(sized))
    taken = lambda frame: {r["source"]: sum(s for i, t, x in rows if x == r["source"] for s in [len(t.split())] if int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) < r["below"]) for r in frame.collect()}
    assert taken(limits) == taken(usual)


def test_near_the_target(documents):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(2000)]
    words, goal = defaultdict(int), {}
    for (i, _, s), r in zip(sorted(rows), sorted(mixing.mix_sources(documents(rows)).collect(), key=lambda r: r["id"])):
        words[s] += r["taken"]
        goal[s] = r["target"]
    assert all(abs(words[s] - goal[s]) <= 7 for s in goal)


def test_empty_tables(documents):
    assert result(documents([])) == []
    assert result(documents([(1, None, None), (2, " \n", "a")])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
