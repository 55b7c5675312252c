import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), ",".join(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(seed=2):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["the", "cat", "Sat", "über", "on", "7", "mat-rat", "É"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([20, 13, 30, 14, 40])] + [(10, "short one here"), (11, ""), (12, None), (2, "repeated id " + text(15)), (None, "no id but words of its own")]
    docs = [(i, text(r.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"{text(5)}\n{r.choice(items)[1] or ''}; {text(r.randrange(300))}") for i in range(40)]
    docs += [(200, None), (201, ""), (202, "--"), (203, items[0][1].upper()), (203, items[0][1]), (204, "cat " * 50), (205, (items[4][1] + " zzz ") * 60), (206, "SHORT, one: here!")]
    return docs, items


def result(documents, spark, docs, items, **kw):
    frame = documents(docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_contamination(frame, benchmark, "hits", **kw).select("doc_id", F.col("hits").alias("found"))
    rows = found.select("doc_id", "found.n_words", decontaminate.n_hit("found").alias("hit"), F.array_join("found.items", ",").alias("items"), decontaminate.is_contaminated("found").alias("bad"))
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize(("shard", "block_words"), [(1 << 18, 2_000_000), (50, 2_000_000), (1 << 18, 12)])
def test_brute_force(documents, spark, monkeypatch, shard, block_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    docs, items = made()
    assert result(documents, spark, docs, items, block_words=block_words) == brute(docs, items)


def test_one_block_at_a_time(documents, spark, live_broadcasts):
    docs, items = made()
    frame, benchmark = documents(docs), spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.search_blocks(benchmark, "item_id", "text", 12)) >= 8
    found = decontaminate.with_contamination(frame, benchmark, "hits", block_words=12)
    assert live_broadcasts["made"] >= 8 and live_broadcasts["most"] == 1 and live_broadcasts["now"] == 0
    assert found.columns == [*frame.columns, "hits"] and found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert decontaminate.with_contamination(documents([]), benchmark, "hits", block_words=12).count() == 0


def test_empty_tables(documents, spark):
    assert result(documents, spark, [], [(1, "a b")]) == []
    assert result(documents, spark, [(1, "a b")], []) == [(1, 2, 0, "", False)]


def test_spans_are_cut_out(documents, spark):
    docs = documents([(1, "Keep this.  One, two THREE! Keep that. one two three"), (2, None), (3, "nothing")])
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    marked = decontaminate.with_contamination(docs, benchmark, "hits")
    got = marked.select("doc_id", decontaminate.without_spans(marked, "hits").alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in got} == {1: "Keep this.  ! Keep that. ", 2: "", 3: "nothing"}


def test_index_parts():
    r = np.random.default_rng(1)
    s = r.integers(0, 6, 700)
    order = decontaminate.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    tree = decontaminate.Wavelet(s.astype(np.int64), 3)
    at = r.integers(0, 701, 200)
    assert tree.rank(np.full(200, 3), at).tolist() == [(s[:i] == 3).sum() for i in at]
    assert tree.access(np.arange(700)).tolist() == s.tolist()
    index, pattern = decontaminate.FMIndex(s), np.array([[1, 2, 3], [4, 4, 1], [5, 1, 9]])
    low, high = index.search(pattern)
    for p, a, b in zip(pattern.tolist(), low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(698) if s[i:i + 3].tolist() == p]
