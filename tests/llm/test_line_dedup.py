import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import line_dedup
from tradeloom.staging import staged

WORDS = ["Alpha", "beta ", "\tgamma", "DELTA", "É", "é", "", "  ", "one two", "ONE TWO\r", "x" * 3000]


def brute(rows, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def texts(n, seed=1):
    r = random.Random(seed)
    return [(i, "\n".join(r.choice([*WORDS, f"own {i}", f"own {r.randrange(9)}"]) for _ in range(r.randrange(1, 12)))) for i in range(n)]


def result(docs, filters, **kw):
    found = line_dedup.drop_lines(docs, filters, "f", **kw)
    return sorted((r["doc_id"], *r["f"]) for r in found.collect())


@pytest.mark.parametrize("block_bytes", [64 << 20, 1])
def test_brute_force(documents, block_bytes):
    rows = [*texts(120), (500, None), (501, ""), (502, "alpha"), (502, "alpha"), (503, "\n\n"), (504, "y\n" * 4000)]
    docs = documents(rows)
    refs = staged(line_dedup.count_lines(docs), "refs")
    filters = staged(line_dedup.build_filters(refs, 10, keys_per_shard=20), "filters")
    assert filters.count() > 1
    assert result(docs, filters, block_bytes=block_bytes) == brute(rows, 10)


def test_one_block_at_a_time(documents, live_broadcasts):
    rows = texts(120)
    docs = documents(rows)
    refs = staged(line_dedup.count_lines(docs), "refs")
    filters = staged(line_dedup.build_filters(refs, 10, keys_per_shard=10), "filters")
    assert filters.count() >= 6
    found = line_dedup.drop_lines(docs, filters, "f", block_bytes=1)
    assert live_broadcasts["made"] >= 6 and live_broadcasts["most"] == 1 and live_broadcasts["now"] == 0
    assert found.columns == [*docs.columns, "f"] and found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], *r["f"]) for r in found.collect()) == brute(rows, 10)
    assert line_dedup.drop_lines(documents([]), filters, "f", block_bytes=1).count() == 0


def test_documents_come_and_go(documents):
    first, added, gone = texts(60), [(900 + i, "beta\nnew line\n" + t) for i, t in texts(15, 2)], texts(60)[:25]
    refs = staged(line_dedup.count_lines(documents(first)), "refs")
    after = staged(line_dedup.merge_refs(refs, line_dedup.count_lines(documents(added)), line_dedup.count_lines(documents(gone))), "refs")
    rest = first[25:] + added
    anew = line_dedup.count_lines(documents(rest))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, anew.collect()))
    filters = staged(line_dedup.build_filters(refs, 10, keys_per_shard=30), "filters")
    updated = staged(line_dedup.update_filters(filters, refs, after, 10), "filters")
    assert result(documents(rest), updated) == brute(rest, 10)
    # Everything inserted is deleted again: the lines that fell below the limit come back.
    back = staged(line_dedup.update_filters(updated, after, refs, 10), "filters")
    assert result(documents(first), back) == brute(first, 10)


def test_empty_table(documents):
    docs = documents([])
    filters = line_dedup.frequent_line_filters(docs)
    assert filters.count() == 0 and result(docs, filters) == []
    assert result(documents([(1, "a")]), filters) == [(1, 1, 0, "a")]


def test_cuckoo_filter():
    r = np.random.default_rng(3)
    held, other = r.integers(-2**62, 2**62, (5000, 2)), r.integers(-2**62, 2**62, (50000, 2))
    cuckoo = line_dedup.Cuckoo.of(held)
    assert cuckoo.holds(held).all() and cuckoo.holds(other).mean() < 0.002
    assert all(cuckoo.delete(*x) for x in cuckoo.places(held[:2500]))
    assert cuckoo.holds(held[2500:]).all() and cuckoo.holds(held[:2500]).mean() < 0.01
    assert len(cuckoo.slots) * 4 * 0.5 < 8192 * 2


def test_minimum_length(documents):
    rows = [(i, f"ab\nabc\néé\nown {i}") for i in range(10)]
    filters = line_dedup.frequent_line_filters(documents(rows), min_docs=10, min_chars=3)
    assert {r[3] for r in result(documents(rows), filters, min_chars=3)} == {f"ab\néé\nown {i}" for i in range(10)}
    assert filters.select(F.sum("n_shards")).first()[0] == 1
