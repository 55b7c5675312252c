import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tradeloom.llm import quality, query_quality


def made(n=400, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9)))
    good = lambda: "\n".join(" ".join(word() for _ in range(r.randrange(5, 30))).capitalize() + "." for _ in range(r.randrange(1, 6)))
    junk = lambda: r.choice([lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: (word() + " ") * 80, lambda: " | ".join(word() for _ in range(60)), lambda: " ".join(word() + r.choice(["###", "$$$", "%%%"]) for _ in range(50))])()
    return [(i, good() if i % 3 else junk(), 1 if i % 3 else 0) for i in range(n)]


def test_held_out_accuracy(spark, documents):
    rows = made()
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, "?") for i, _, q in rows], "doc_id long, quality int, text string")
    forest = quality.train(docs, labels.where(~query_quality.held_out()))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score_column(docs, forest).alias("s")).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 90 and sum((s >= 0.5) == (q == 1) for s, q in held) / len(held) >= 0.98
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_rows_teach_nothing(spark, documents):
    rows = made(90)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = lambda wrong: spark.createDataFrame([(i, 1 - q if wrong and zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in rows], "doc_id long, quality int")
    a, b = (quality.train(docs, labels(x).where(~query_quality.held_out())) for x in (False, True))
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)


def test_flat_trees_walk_like_nested_ones():
    r = np.random.default_rng(3)
    x = r.standard_normal((500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = quality.fit(x, y, trees=20)

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    want = [forest.base + sum(walk(row, root) for root in forest.roots) for row in x]
    assert np.allclose(forest.margin(x), want) and ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_odd_rows_and_labels(spark, documents):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x" * 1_000_000), (4, "again"), (None, "no id")]
    docs = documents(rows)
    none = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    one = spark.createDataFrame([(4, 1), (4, 1), (9, 0)], "doc_id long, quality int")
    scores = lambda labels: [r["s"] for r in docs.select(quality.score_column(docs, quality.train(docs, labels)).alias("s")).collect()]
    assert scores(none) == [0.5] * 6
    assert all(s > 0.5 for s in scores(one))
    assert documents([]).select(quality.score_column(docs, quality.Forest(0.0, [])).alias("s")).count() == 0
    assert docs.where(query_quality.held_out()).count() == sum(i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows)
    assert docs.select(F.size(quality.feature_column())).distinct().first()[0] == len(quality.FEATURES)
