import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tradeloom.llm import toxicity

CATEGORIES = {"heavy": "toxic = 1 AND found >= 6", "toxic": "toxic = 1"}
BAD = ["zorgla", "muffwort", "krax"]


def made(n=600, seed=2):
    r = random.Random(seed)
    plain = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randrange(1, 6)):
                words[r.randrange(len(words))] = r.choice(BAD) + r.choice(["", "", "ene", "isch", "ot"])
        rows.append((i, " ".join(words).capitalize(), int(toxic)))
    return rows


def scores(docs, labels, **kw):
    vocabulary, chain = toxicity.train(docs, labels, {k: F.expr(v) for k, v in CATEGORIES.items()}, **kw)
    got = docs.select("doc_id", toxicity.toxicity_column(docs, vocabulary, chain, list(CATEGORIES)).alias("p")).collect()
    return [(r["doc_id"], r["p"]["toxic"], r["p"]["heavy"]) for r in got], vocabulary, chain


def test_held_out_accuracy(spark, documents):
    rows = made()
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x, "?") for i, _, x in rows if i < 400], "doc_id long, toxic int, text string")
    got, vocabulary, chain = scores(docs, labels)
    truth = {i: x for i, _, x in rows}
    held = [(p, truth[i]) for i, p, _ in got if i >= 400]
    assert sum(p >= 0.5 for p, x in held if x) / sum(x for _, x in held) >= 0.95
    assert not [p for p, x in held if not x and p >= 0.5]
    assert {"krax", "zorg-", "muff-"} <= vocabulary.keys() and chain.models[1].dense.shape == (1,)


def test_later_models_see_unseen_probabilities():
    """The second category equals the first; noise that fits the training rows can't pass for it."""
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 200).astype(float)
    sets = [np.array(sorted({int(a * 2 + b), 10 + i})) for i, (a, b) in enumerate(zip(y, r.integers(0, 2, 200)))]
    chain = toxicity.fit_chain(sets, np.column_stack([y, y]), np.arange(200) % 3, 300)
    p = chain.probabilities([s[:1] for s in sets])
    assert ((p[:, 1] >= 0.5) == (y == 1)).mean() > 0.95 and chain.models[1].dense[0] > 0.5


def test_odd_rows_and_labels(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "Krax " * 50_000), (3, "krax"), (None, "x")])
    for labels in ([], [(1, None), (2, None)], [(1, 1), (2, 1)], [(1, 1), (3, 0), (None, 1)]):
        got, vocabulary, _ = scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len(got) == 5 and all(0 <= p <= 1 and 0 <= q <= 1 for _, p, q in got)
    assert scores(docs, spark.createDataFrame([], "doc_id long, toxic int"))[0][0][1] == 0.5
    assert scores(documents([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))[0] == []


def features(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return words | {w[:k] + "-" for w in words for k in (4, 5) if len(w) >= k}


def test_features_against_a_count_by_hand(spark, documents):
    rows = made(300) + [(900, None, 0), (901, "", 1), (902, "Krax krax KRAX-7_krax", 1), (902, "Krax krax KRAX-7_krax", 1)]
    given = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, given int")
    n, n_given = {}, {}
    for _, t, x in rows:
        for f in features(t):
            n[f], n_given[f] = n.get(f, 0) + 1, n_given.get(f, 0) + x
    assert {r["feature"]: (r["n"], r["n_given"]) for r in toxicity.count_features(given).collect()} == {f: (n[f], n_given[f]) for f in n}
    total, share = len(rows), sum(x for *_, x in rows) / len(rows)
    chi = {f: (n_given[f] - n[f] * share) ** 2 / (n[f] * share * (1 - n[f] / (total + 1)) * (1 - share)) for f in n if n[f] >= 4}
    best = sorted((f for f in chi if chi[f] >= 20), key=lambda f: (-chi[f], f))[:12]
    vocabulary, telling = toxicity.choose_features(given, 12, 4)
    assert set(vocabulary) == set(best) and sorted(vocabulary.values()) == list(range(len(best)))
    assert telling == sum(n_given[f] >= 0.9 * n[f] for f in best) and all((vocabulary[f] < telling) == (n_given[f] >= 0.9 * n[f]) for f in best)


def test_scores_against_a_chain_by_hand(spark, documents):
    rows = [(i, t) for i, t, _ in made(60)] + [(900, None), (901, ""), (902, "KRAXene krax " * 500)]
    r = np.random.default_rng(3)
    vocabulary = {f: i for i, f in enumerate(sorted({f for _, t in rows for f in features(t)})[::3])}
    models = [toxicity.Linear(r.normal(size=len(vocabulary)), r.normal(size=i), float(r.normal())) for i in range(3)]
    docs = documents(rows)
    got = docs.select("doc_id", toxicity.toxicity_column(docs, vocabulary, toxicity.Chain(models), ["a", "b", "c"]).alias("p")).collect()
    for row, (_, text) in zip(sorted(got, key=lambda x: x["doc_id"]), sorted(rows)):
        before = []
        for m in models:
            margin = m.bias + sum(m.weights[vocabulary[f]] for f in features(text) if f in vocabulary) + sum(w * p for w, p in zip(m.dense, before))
            before.append(1 / (1 + math.exp(-max(-35, min(35, margin)))))
        assert np.allclose(list(row["p"]), before, rtol=1e-9, atol=1e-15)


def test_regression_converges():
    """At the end the loss is as low as plain gradient descent gets it in many steps."""
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 12))) for _ in range(500)]
    columns, true = r.random((500, 2)), r.normal(size=40) * 2
    y = np.array([float(true[s].sum() + c @ [3, -2] + r.normal() > 0) for s, c in zip(sets, columns)])
    dense = np.zeros((500, 43))
    for i, s in enumerate(sets):
        dense[i, s] = 1
    dense[:, 40:42], dense[:, 42] = columns, 1
    loss = lambda x: np.mean(np.logaddexp(0, dense @ x) - y * (dense @ x)) + 0.005 * (x[:-1] @ x[:-1])
    m, x = toxicity.fit_linear(sets, columns, y, 40, ridge=0.01, tolerance=1e-9), np.zeros(43)
    for _ in range(20_000):
        x -= 0.5 * (dense.T @ (1 / (1 + np.exp(-dense @ x)) - y) / 500 + 0.01 * np.append(x[:-1], 0))
    assert abs(loss(np.concatenate([m.weights, m.dense, [m.bias]])) - loss(x)) < 1e-6
