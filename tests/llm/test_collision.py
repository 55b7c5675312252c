import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import collision


def run(spark, rows, k=20):
    frame = spark.createDataFrame([(i, v, 1, "?") for i, v in rows], "vec_id long, embedding array<float>, id long, shard string")
    out = {}
    for r in sorted(collision.nearest(frame, F.col("vec_id") % 20 == 0, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def brute(rows, k=20):
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-float((x * v).sum()), i) for i, x in ok if i != q and len(x) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize(("shard", "queries"), [(8192, 1024), (700, 40)])
def test_recall(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(collision, "SHARD", shard)
    monkeypatch.setattr(collision, "QUERIES", queries)
    r = np.random.default_rng(6)
    centres = r.standard_normal((8, 48))
    x = centres[r.integers(0, 8, 3000)] + 1.2 * r.standard_normal((3000, 48))
    x *= r.uniform(0.3, 2.0, (3000, 1))  # lengths matter to the inner product
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(s >= want[q][-1][1] - 1e-9 for q in got for _, s in got[q])
    assert hits / sum(map(len, want.values())) >= 0.95
    exact = {i: np.array(v) for i, v in rows}
    assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-9 for q in got for i, s in got[q])


def test_odd_vectors_and_ties(spark):
    same = [1.0, 0.5]
    rows = [(i, same) for i in range(30)] + [(40, [0.0, 0.0]), (60, None), (80, []), (100, [1.0, None]), (120, [float("nan"), 1.0]), (121, [float("inf"), 1.0]),
            (140, [1.0, 2.0, 3.0]), (141, [1.0, 2.0, 2.0]), (160, [-3.0, 1.0]), (5, same), (None, same)]
    got = run(spark, rows)
    assert set(got) == {0, 20, 140, 160}
    assert [i for i, _ in got[20]] == [0, 1, 2, 3, 4, 5, 5, *range(6, 19)]
    assert got[140] == [(141, 11.0)]
    assert [i for i, _ in got[160]] == [0, 1, 2, 3, 4, 5, 5, *range(6, 19)]


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, [(0, [1.0]), (1, [2.0]), (20, [2.0])]) == {0: [(1, 2.0), (20, 2.0)], 20: [(1, 4.0), (0, 2.0)]}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {}


def recall(got, want):
    return sum(s >= want[q][-1][1] - 1e-9 for q in got for _, s in got[q]) / sum(map(len, want.values()))


def test_recall_in_many_dimensions(spark):
    """Unit vectors without any structure, which no projection tells apart well."""
    x = np.random.default_rng(8).standard_normal((1500, 768))
    rows = [(i, v) for i, v in enumerate((x / np.sqrt((x ** 2).sum(axis=1))[:, None]).astype(np.float32).tolist())]
    assert recall(run(spark, rows), brute(rows)) >= 0.95


def test_recall_on_the_given_vectors(spark):
    import os

    table = spark.read.parquet(f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    want = {}
    for q in ids[ids % 20 == 0].tolist():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        want[q] = [(0, v) for v in -np.sort(-scores)[:20]]
    got = {}
    for r in collision.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
