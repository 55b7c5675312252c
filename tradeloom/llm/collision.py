"""Nearest neighbours by collision counting on single projections.

The largest inner product is turned into the smallest distance: every vector gets one more
coordinate that brings it to the largest length M of all, queries are scaled to M and get 0.
Vectors are dealt into shards by a hash of their id. A shard's index is, for each of ``m``
random projections, the array of its vectors sorted by projected value. A query opens a window
around its own value in every array; virtual rehashing widens the windows step by step. A
vector's collisions are the windows that hold its place in the arrays; one with at least
``share`` of them is verified by its exact inner product. A query is done in a shard when its k-th best
distance is so small against the windows that nearer vectors have collided (``safe``); should
the windows end before, the whole shard is verified.

Projections depend on the dimension alone, nothing is fitted to a sample, and every vector is
indexed. A shard's index is built once and stored. A task reads it and lets a bounded number of
queries pass over it; it returns the k best for each query, of which a window keeps the best k.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or
whose id is null, take no part; vectors meet only vectors of their own dimension; a query with
fewer candidates returns them all; equal scores rank by smaller id; rows that repeat an id are
candidates of their own, but none for their own id, and as a query the smallest of them counts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.llm.common import small
from tradeloom.staging import staged

SHARD, QUERIES = 8192, 65536
PROJECTIONS, SHARE, SAFE = 64, 0.8, 1.6
FIRST, WIDEN, STEPS = 0.5, 1.5, 5
_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


class Shard:
    """Sorted projections (at most 255, so that a byte counts them) of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS):
        self.x, self.longest = vectors, longest
        n, d = vectors.shape
        self.lines = np.random.default_rng(d).standard_normal((projections, d + 1))
        extra = np.sqrt(np.maximum(0.0, longest ** 2 - (vectors ** 2).sum(axis=1)))
        values = vectors @ self.lines[:, :d].T + extra[:, None] * self.lines[None, :, d]
        order = np.argsort(values, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(values.T, order, axis=1)
        # Where each vector stands in each sorted array: it lies in a window if its place does.
        self.place = np.empty(order.shape, dtype=np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)
        self._prepare()

    def kept(self) -> tuple:
        return self.x, self.longest, self.lines, self.sorted, self.place

    @staticmethod
    def of(kept: tuple) -> Shard:
        shard = Shard.__new__(Shard)
        shard.x, shard.longest, shard.lines, shard.sorted, shard.place = kept
        shard._prepare()
        return shard

    def _prepare(self) -> None:
        self.offset, self.inside = np.empty_like(self.place), np.empty(self.place.shape, dtype=bool)
        self.radii = self.longest * FIRST * WIDEN ** np.arange(STEPS)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the windows of every query, step and projection: arrays (queries, steps, projections)."""
        value = queries @ self.lines[:, :-1].T * (self.longest / np.sqrt((queries ** 2).sum(axis=1)))[:, None]
        low = np.stack([np.searchsorted(s, v[:, None] - self.radii) for s, v in zip(self.sorted, value.T)], axis=2)
        high = np.stack([np.searchsorted(s, v[:, None] + self.radii, "right") for s, v in zip(self.sorted, value.T)], axis=2)
        return low, high

    def nearest(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, share: float, safe: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best vectors found; ``own`` marks rows that don't count, ``low``
        and ``high`` are the query's windows by step."""
        n, length = len(self.x), np.sqrt((query ** 2).sum())
        tested, best, kinds = own.copy(), np.full(k, -np.inf), self.place.dtype
        scores = np.full(n, -np.inf)
        needed, n_own = int(np.ceil(share * len(self.lines))), int(own.sum())
        for step in range(STEPS + 1):
            if step == STEPS:
                new = np.flatnonzero(~tested)
            else:
                np.subtract(self.place, low[step].astype(kinds)[:, None], out=self.offset)
                np.less(self.offset, (high[step] - low[step]).astype(kinds)[:, None], out=self.inside)
                collisions = self.inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
                new = np.flatnonzero((collisions >= needed) & ~tested)
            if len(new):
                tested[new] = True
                scores[new] = self.x[new] @ query
                best = np.partition(np.concatenate([best, scores[new]]), len(new))[len(new):]
            n_tested = int(np.count_nonzero(tested))
            if n_tested == n:
                break
            if n_tested - n_own >= k and step < STEPS:
                if np.sqrt(max(0.0, 2 * self.longest ** 2 - 2 * self.longest * best.min() / length)) * safe <= self.radii[step]:
                    break
        # The k best are scored once more, term by term in one order, so that equal vectors tie.
        found = np.flatnonzero((scores >= best.min() - 1e-9 * max(1.0, self.longest * length)) & (scores > -np.inf))
        exact = (self.x[found] * query).sum(axis=1)
        order = np.lexsort((ids[found], -exact))[:k]
        return found[order], exact[order]


def stored(vectors: pd.DataFrame, longest: float) -> pd.DataFrame:
    """A shard's index and ids as one cell."""
    ids = vectors["id"].to_numpy(dtype=np.int64)
    shard = Shard(np.stack(vectors["v"].to_numpy()).astype(np.float64), longest)
    return pd.DataFrame({"dim": [int(vectors["dim"].iloc[0])], "shard": [int(vectors["shard"].iloc[0])], "index": [pickle.dumps((shard.kept(), ids), protocol=5)]})


def search(batches: Iterator[pa.RecordBatch], k: int, share: float, safe: float) -> Iterator[pa.RecordBatch]:
    """The k best of each query in the shard whose index came before it."""
    shard, ids = None, None
    for batch in batches:
        index, ask = batch.column(0), batch.column(1)
        places = np.flatnonzero(index.is_valid().to_numpy(zero_copy_only=False)).tolist()
        # Stretches of queries between the indexes of this batch.
        for begin, end in zip([-1, *places], [*places, batch.num_rows]):
            if begin >= 0:
                made, ids = pickle.loads(index[begin].as_py())
                shard = Shard.of(made)
            for a in range(begin + 1, end, 128):
                n = min(128, end - a)
                asked = np.stack(batch.column(2).slice(a, n).to_numpy(zero_copy_only=False)).astype(np.float64)
                low, high = shard.windows(asked)
                found = [(q, *shard.nearest(asked[i], low[i], high[i], ids == q, ids, k, share, safe)) for i, q in enumerate(ask.slice(a, n).to_pylist())]
                columns = [np.concatenate([np.full(len(r), q, dtype=np.int64) for q, r, _ in found]), np.concatenate([ids[r] for _, r, _ in found]), np.concatenate([s for _, _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, share: float = SHARE, safe: float = SAFE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every row where ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    longest, n, n_queries = rows.agg(F.max(length), F.count("*"), F.count_if("q")).first()
    shards, parts, longest = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES)), longest or 1.0
    dealt = lambda into, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(into)).cast("int")
    groups = rows.select("id", "v", F.size("v").alias("dim"), dealt(shards, 1).alias("shard")).groupBy("dim", "shard")
    indexed = staged(groups.applyInPandas(lambda pdf: stored(pdf, longest), "dim int, shard int, index binary"), "collision-index")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("part", dealt(parts, 2))
    asked = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "part", "id", "v")
    # A shard without vectors of a query's dimension has no index, and the query nothing to look for there.
    asked = asked.join(small(indexed.select("dim", "shard")), ["dim", "shard"]).select("dim", "shard", "part", F.lit(None).cast("binary").alias("index"), "id", "v")
    heads = indexed.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "index", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    key = ["dim", "shard", "part"]
    both = heads.unionByName(asked).repartition(max(1, min(shards * parts, 100_000)), *key).sortWithinPartitions(*key, F.asc_nulls_first("id"))
    found = both.select("index", "id", "v").mapInArrow(lambda batches: search(batches, k, share, safe), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
