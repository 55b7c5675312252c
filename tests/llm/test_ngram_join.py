import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tradeloom.llm import components, ngram_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    key = lambda i: (rows[i][0] is not None, rows[i][0])
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(4, 5):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    smallest = lambda ids: min((rows[i][0] for i in ids if rows[i][0] is not None), default=None)
    return sorted(((rows[i][0], smallest(groups[find(i)]) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))), key=str)


def made(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([6, 40, 200]))]
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = word()
            rows.append((1000 - len(rows), " ".join(w)))
        rows.append((1000 - len(rows), " ".join(base).upper() + "."))
    return rows + [(2000, None), (2001, ""), (2002, "..."), (2003, "two words"), (2004, "Two, words"), (2005, "other words"), (5, rows[0][1]), (5, rows[0][1]), (6, rows[3][1]), (6, "not that text at all")]


def result(frame):
    return sorted(((r["id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(frame).collect()), key=str)


@pytest.mark.parametrize("block", [1024, 4])
def test_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = made()
    assert result(documents(rows)) == brute(rows)


def test_null_ids_and_empty_table(documents):
    assert result(documents([])) == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "")]
    assert result(documents(rows)) == [(3, 3, 1), (None, 3, 1), (None, None, 0)]


def test_banding_reaches_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.999, 144)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and bands * rows <= 144 and rows == 6


def test_intersections():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in r.integers(1, 150, 60)] + [np.unique(r.integers(0, 10**6, 50)).astype(np.uint64) for _ in range(40)]
    got = ngram_join.intersections(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a, b in itertools.permutations(range(100), 2))


def test_shingles_of_long_and_odd_texts():
    texts = [b"a b c d e f", "É é ß".encode(), b"", b"x " * 300_000, b"A  b\tc.d,e F"]
    sets = ngram_join.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 1, 0, 1, 2] and (sets[0] == sets[4]).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)] + [(3, 3)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
