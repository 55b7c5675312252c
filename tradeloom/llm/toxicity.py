"""Toxicity by a classifier chain of linear models.

Features are the distinct words of a text and their first 4 and 5 characters, so that new
endings of a known stem are met. Over all labelled documents Spark counts in how many toxic
and other ones each feature occurs; the ``max_features`` with the largest chi-square against
the last category, the given one, are kept, if it is too large for chance (``min_chi``). The chain predicts the
categories one after the other, the given one at the end: each is a logistic regression, fitted until it
converges, over the kept features and the probabilities of the categories before it.
While it is trained, those probabilities come from models that didn't see the row (out of
fold, by a hash of the id), as they will when it is used; the models that stay are then fitted
to all training rows.

Counting takes all labelled rows; the regressions at most ``max_rows`` of them, those with the
smallest hash of their id.

Defined results: a null or empty text has no features and gets the base rate; null labels are
left out, repeated labelled rows count repeatedly; without labelled rows every probability is
0.5; an empty table gives an empty result; texts are read whole, whatever their length; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tradeloom.llm.common import in_parts, list_array, small, struct_array

_WORD = re.compile(r"[^\W\d_]+")


def features_of(raw: bytes) -> set[str]:
    words = set(_WORD.findall(raw.decode().lower()))
    return words | {f"{w[:4]}-" for w in words if len(w) >= 4} | {f"{w[:5]}-" for w in words if len(w) >= 5}


def count_features(rows: DataFrame) -> DataFrame:
    """(feature, n, n_given) over rows (text, given): documents with it, and those of the category."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in in_parts(batch.column(0)):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for raw, given in zip(part, batch.column(1).slice(at, len(part)).to_pylist()):
                    found = features_of(raw)
                    seen[0].update(found)
                    if given:
                        seen[1].update(found)
                names = list(seen[0])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["feature", "n", "n_given"])

    return rows.mapInArrow(per_batch, "feature string, n long, n_given long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_given").alias("n_given"))


def choose_features(rows: DataFrame, max_features: int, min_docs: int, min_chi: float = 20.0) -> tuple[dict[str, int], int]:
    """The features that tell the given category best, and how many of them nearly always mean
    it; those have the lowest numbers."""
    total, given = rows.agg(F.count("*"), F.sum("given")).first()
    if not total or not given or given == total:
        return {}, 0
    expected = F.col("n") * (given / total)
    chi = (F.col("n_given") - expected) ** 2 / (expected * (1 - F.col("n") / (total + 1)) * (1 - given / total))
    best = count_features(rows).where((F.col("n") >= min_docs) & (chi >= min_chi)).orderBy(F.desc(chi), "feature").limit(max_features).collect()
    telling = [r["feature"] for r in best if r["n_given"] >= 0.9 * r["n"]]
    return {f: i for i, f in enumerate([*telling, *(r["feature"] for r in best if r["n_given"] < 0.9 * r["n"])])}, len(telling)


def index_column(docs: DataFrame, vocabulary: dict[str, int], text_col: str = "text") -> Column:
    """Numbers of the kept features of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(texts: pa.Array) -> pa.Array:
        known = sent.value
        return list_array([np.array(sorted(known[f] for f in features_of(t) & known.keys()), dtype=np.int32) for _, part in in_parts(texts) for t in part], pa.int32())

    return arrow_udf(index, "array<int>")(F.col(text_col))


class Linear:
    """Logistic regression over a set of feature numbers and some dense columns."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def probability(self, sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        return self.of_pairs(*pairs_of(sets), columns)

    def of_pairs(self, row: np.ndarray, feature: np.ndarray, columns: np.ndarray) -> np.ndarray:
        margin = self.bias + np.bincount(row, self.weights[feature], minlength=len(columns)) + columns @ self.dense
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def pairs_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every element of the sets."""
    feature = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))), feature


def fit_linear(sets: list[np.ndarray], columns: np.ndarray, y: np.ndarray, n_features: int, ridge: float = 1e-6, tolerance: float = 1e-4, memory: int = 8) -> Linear:
    """Minimum of the ridge-penalised mean loss, by limited-memory BFGS. It ends when a step lowers the
    loss by less than ``tolerance`` of it; every step lowers it, so it does end."""
    n, k = len(y), columns.shape[1]
    share = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    start = np.append(np.zeros(n_features + k), np.log(share / (1 - share)))
    model = lambda x: Linear(x[:n_features], x[n_features:-1], float(x[-1]))
    if not n or y.min() == y.max():
        return model(start)
    row, feature = pairs_of(sets)

    def loss_at(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = x[-1] + np.bincount(row, x[feature], minlength=n) + columns @ x[n_features:-1]
        error = (1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))) - y) / n
        slope = np.concatenate([np.bincount(feature, error[row], minlength=n_features), columns.T @ error, [error.sum()]])
        slope[:-1] += ridge * x[:-1]
        return float(np.mean(np.logaddexp(0, margin) - y * margin) + ridge / 2 * (x[:-1] @ x[:-1])), slope

    x, (loss, slope), kept = start, loss_at(start), []
    while True:
        way, factors = slope.copy(), []
        for moved, turned, scale in reversed(kept):
            factors.append(scale * (moved @ way))
            way -= factors[-1] * turned
        way *= kept[-1][0] @ kept[-1][1] / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(float(np.linalg.norm(slope)), 1e-12)
        for (moved, turned, scale), factor in zip(kept, reversed(factors)):
            way += moved * (factor - scale * (turned @ way))
        step, down = 1.0, float(slope @ way)
        while (tried := loss_at(x - step * way))[0] > loss - 1e-4 * step * down and step > 1e-10:
            step /= 2
        if not loss - tried[0] > tolerance * loss:
            return model(x - step * way if tried[0] < loss else x)
        moved, turned = -step * way, tried[1] - slope
        if moved @ turned > 1e-18:
            kept = [*kept, (moved, turned, 1 / (moved @ turned))][-memory:]
        x, (loss, slope) = x + moved, tried


class Chain:
    """Models in order; each sees the probabilities of those before it."""

    def __init__(self, models: list[Linear]):
        self.models = models

    def probabilities(self, sets: list[np.ndarray]) -> np.ndarray:
        known = np.zeros((len(sets), 0))
        for model in self.models:
            known = np.column_stack([known, model.probability(sets, known)])
        return known


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, n_features: int) -> Chain:
    """``labels`` has one 0/1 column per category, ``fold`` the part each row is left out in."""
    known, models = np.zeros((len(sets), 0)), []
    for c in range(labels.shape[1]):
        y, unseen = labels[:, c], np.zeros(len(sets))
        for part in np.unique(fold):
            inside, outside = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
            pick = lambda rows: [sets[i] for i in rows]
            unseen[outside] = fit_linear(pick(inside), known[inside], y[inside], n_features).probability(pick(outside), known[outside])
        models.append(fit_linear(sets, known, y, n_features))
        known = np.column_stack([known, unseen])
    return Chain(models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_features: int = 4096, min_docs: int = 4,
          max_rows: int = 20_000, folds: int = 3) -> tuple[dict[str, int], Chain]:
    """Vocabulary and chain. A category is a boolean column over the labels' columns and ``found``,
    the number of telling features in the text. The last category is the given one: its features are chosen,
    rows where it is null are left out, and it can't use ``found``.

    The labels are broadcast for counting if there are few of them, and the chosen ones always:
    ``max_rows`` bounds them."""
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    given = list(categories.values())[-1]
    known = labels.withColumn("_id", F.col(id_col)).withColumn("_given", given.cast("int")).where("_given IS NOT NULL AND _id IS NOT NULL")
    counted = text.join(small(known.select("_id", "_given")), "_id").select(F.col("_text").alias("text"), F.col("_given").alias("given"))
    vocabulary, n_telling = choose_features(counted, max_features, min_docs)
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id", "_given").limit(max_rows))
    rows = text.join(chosen, "_id").withColumn("_set", index_column(docs, vocabulary, "_text")).drop("_text")
    rows = rows.withColumn("found", F.size(F.filter("_set", lambda x: x < n_telling)))
    wanted = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_y{i}") for i, c in enumerate(categories.values())]
    got = rows.select("_id", "_set", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(folds)).alias("_fold"), *wanted).toPandas()
    if not len(got):
        return vocabulary, Chain([Linear(np.zeros(len(vocabulary)), np.zeros(i), 0.0) for i in range(len(categories))])
    got = got.sort_values("_id", kind="stable")
    sets = [np.asarray(s, dtype=np.int64) for s in got["_set"]]
    return vocabulary, fit_chain(sets, got[[f"_y{i}" for i in range(len(categories))]].to_numpy(), got["_fold"].to_numpy(), len(vocabulary))


def toxicity_column(docs: DataFrame, vocabulary: dict[str, int], chain: Chain, names: list[str], text_col: str = "text") -> Column:
    """A column struct with one probability per category."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, chain))

    def score(texts: pa.Array) -> pa.Array:
        known, model = sent.value
        p = model.probabilities([np.array([known[f] for f in features_of(t) & known.keys()], dtype=np.int64) for _, part in in_parts(texts) for t in part])
        return struct_array({name: pa.array(p[:, i], pa.float64()) for i, name in enumerate(names)})

    return arrow_udf(score, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(F.col(text_col))
