"""Embedding whitening with eigenvectors in mixed precision.

A vector's entries become whole numbers, floor(256 c). The fit list holds each distinct vector once.
Tasks add up its sums exactly, then the centred products of the covariance, a matrix each, and
Spark adds up the tasks' numbers; the vectors themselves stay where they are. The covariance, d x d
for dimension d, goes to the driver. Its eigenvectors are first computed in float32 and
then corrected by the iteration of Ogita and Aishima, a few matrix products in extended
precision that double the number of right digits each time. Eigenvectors whose eigenvalues lie closer
together than the present error can't be told apart that way: the covariance is projected on
the space they span, shifted by their mean eigenvalue, and the small problem solved anew
inside the cluster, until rounding alone is left.

Eigenvectors have length 1, and their sign makes the first of their largest entries positive.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped;
rows that repeat a vector count once in the fit and all get results, rows that repeat an id get
theirs each, null ids too; vectors of different dimensions are fitted and whitened apart from each
other; a dimension below 4 has that many components; entries beyond the range of a long stay
at its ends; a component whose variance is nothing but rounding has a null ``whitened`` and counts
for no error, and without any variance ``explained`` is null; a ``deviation`` that no long holds
is null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tradeloom.llm.common import list_array, struct_array
from tradeloom.staging import staged

_FIT = "dim int, width int, x binary"
_WHITENED = "struct<deviation:bigint,whitened:array<double>>"
_LARGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(c: np.ndarray) -> np.ndarray:
    """floor(256 c) of doubles as longs."""
    with np.errstate(over="ignore"):
        big = np.floor(c * 256.0)
    return np.where(big >= 2.0 ** 63, _LARGEST, np.where(big < -(2.0 ** 63), -_LARGEST - 1, np.clip(big, -(2.0 ** 63), 2.0 ** 62 * 1.9999999).astype(np.int64)))


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and long entries of the vectors (without nulls) of a batch, for each dimension."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, whole(flat[(ends[rows] - d)[:, None] + np.arange(d)])


def fit_list(vectors: DataFrame, vector_col: str = "v") -> DataFrame:
    """Each distinct vector once, in as few bytes an entry as hold it."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                most = np.where(x < 0, ~x, x).max(axis=1, initial=0)
                widths = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
                for w in np.unique(widths):
                    rows = np.unique(x[widths == w].astype(f"<i{w}"), axis=0)
                    n, d = rows.shape
                    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * d * w, d * w, dtype=np.int32)), pa.py_buffer(rows.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, w), pa.int32()), packed], ["dim", "width", "x"])

    return vectors.select(vector_col).mapInArrow(pack, _FIT).distinct()


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch of the fit list, a matrix for each dimension and width."""
    dim, width = (batch.column(c).to_numpy() for c in (0, 1))
    for d, w in set(zip(dim.tolist(), width.tolist())):
        rows = batch.column(2).filter(pa.array((dim == d) & (width == w)))
        yield np.frombuffer(b"".join(rows.to_pylist()), dtype=f"<i{w}").reshape(-1, d).astype(np.int64)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sum of each entry, by dimension. Halves of an entry are added up
    apart, so that no task's sum leaves a long."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in (x for batch in batches for x in unpacked(batch)):
            part = np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            held[x.shape[1]] = held.get(x.shape[1], 0) + part
        for d, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(d, d), np.arange(d), *part)], ["dim", "i", "n", "high", "low"])

    parts = fit.mapInArrow(add, "dim long, i long, n long, high long, low long").groupBy("dim", "i")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("dim", "i").collect():
        found.setdefault(r["dim"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return found


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n; the difference n x - S is taken in whole numbers."""
    mean = [s // n for s in total]
    if max(map(abs, mean)) < 1 << 61 and np.abs(x.astype(np.float64)).max(initial=0) < 1 << 61:
        rest = np.array([(s - m * n) / n for s, m in zip(total, mean)])
        return (x - np.array(mean, dtype=np.int64)).astype(np.float64) - rest
    return ((x.astype(object) * n - np.array(total, dtype=object)) / n).astype(np.float64)


def products(fit: DataFrame, made, size: int) -> dict[int, np.ndarray]:
    """Sum over the fit list of what ``made`` (matrix of vectors to matrix) gives, by dimension. A task
    sends one matrix of its dimension, and Spark adds up the numbers."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in (x for batch in batches for x in unpacked(batch)):
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + made(x)
        for d, part in held.items():
            i, j = np.nonzero(np.ones(part.shape))
            for a in range(0, len(i), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[b]), d), pa.int64()), pa.array(i[b], pa.int64()), pa.array(j[b], pa.int64()), pa.array(part[i[b], j[b]])], ["dim", "i", "j", "p"])

    parts = fit.mapInArrow(add, "dim long, i long, j long, p double").groupBy("dim", "i", "j").agg(F.sum("p").alias("p"))
    got = parts.toPandas()
    out = {}
    for d, part in got.groupby("dim"):
        out[d] = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        out[d][part["i"], part["j"]] = part["p"]
    return out


def eigenvectors(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    d, a = len(a), a.astype(np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(d), np.eye(d)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eps = np.finfo(np.longdouble).eps
    size, last = float(np.abs(a).sum(axis=1).max()), np.inf
    for _ in range(rounds):
        r, s = np.eye(d) - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        off = s + r * (value[:, None] + value[None, :]) / 2
        np.fill_diagonal(off, 0)
        near = 2 * (np.sqrt((off ** 2).sum()) + size * np.sqrt((r ** 2).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        # The half of r restores length 1 and right angles, the rest, antisymmetric, turns.
        e = r / 2 + np.where(apart, off / np.where(apart, gap, 1), 0)
        x = x + x @ e
        step, clusters = float(np.abs(e).max()), 0
        # Inside a cluster the covariance, shifted by its mean eigenvalue, is solved anew.
        order = np.argsort(value)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(value[order]) > near, [True]]))
        for begin, end in zip(edges[:-1], edges[1:]):
            if end - begin > 1:
                inside = order[begin:end]
                basis, shift = x[:, inside], value[inside].mean()
                small = basis.T @ (a @ basis) - shift * (basis.T @ basis)
                weight = np.abs(small).max()
                if weight > size * d * eps:
                    turn = np.linalg.eigh(((small + small.T) / (2 * weight)).astype(np.float64))[1]
                    x[:, inside], clusters = basis @ turn, clusters + 1
        if not clusters and (step < 1e-17 or step < 1e-6 and step >= last / 2):
            break
        last = step
    x = x / np.sqrt((x ** 2).sum(axis=0))
    value = np.einsum("ij,ij->j", x, a @ x) * scale
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order].astype(np.float64), value[order].astype(np.float64)
    size = np.abs(x)
    first = np.argmax(size >= size.max(axis=0) * (1 - 1e-9), axis=0)
    return value, x * np.where(x[first, np.arange(d)] < 0, -1.0, 1.0)


class Whitening:
    """What whitens vectors of one dimension: the first components of the fit list."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray, components: int):
        self.n, self.total = n, total
        value, vectors = eigenvectors(covariance)
        trace = float(np.trace(covariance))
        k = min(components, len(total))
        self.value, self.vectors = value[:k], vectors[:, :k]
        self.real = self.value > max(trace, 0.0) * len(total) * np.finfo(np.float64).eps
        self.explained = [float(v) / trace if trace > 0 else None for v in self.value]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column a component, 0 where it has no variance."""
        return centred(x, self.n, self.total) @ self.vectors / np.where(self.real, np.sqrt(np.maximum(self.value, 0)), np.inf)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        rough = ((self.n * x.astype(np.float64) - np.array([float(s) for s in self.total])) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0 ** 62 and self.n * max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) < 2.0 ** 62 and max(map(abs, self.total)) < 1 << 62:
            return ((self.n * x - np.array(self.total, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.total, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v <= _LARGEST else None for v in exact]


def fit(vectors: DataFrame, vector_col: str = "v", components: int = 4) -> tuple[dict[int, Whitening], float]:
    """What whitens the vectors of each dimension, and the largest entry of the covariance of the
    whitened fit list minus the identity."""
    listed = staged(fit_list(vectors, vector_col), "fit-list")
    known, context = sums(listed), vectors.sparkSession.sparkContext
    sent = context.broadcast(known)

    def cross(x: np.ndarray) -> np.ndarray:
        c = centred(x, *sent.value[x.shape[1]])
        return c.T @ c

    models = {d: Whitening(*known[d], p / known[d][0], components) for d, p in products(listed, cross, components).items()}
    model = context.broadcast(models)
    means = {d: p[0] / known[d][0] for d, p in products(listed, lambda x: model.value[x.shape[1]].whitened(x).sum(axis=0)[None, :], components).items()}
    middle = context.broadcast(means)

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.value[x.shape[1]].whitened(x) - middle.value[x.shape[1]]
        return w.T @ w

    errors = [0.0]
    for d, p in products(listed, spread, components).items():
        real = models[d].real
        errors.append(float(np.abs(p / known[d][0] - np.eye(len(real)))[np.ix_(real, real)].max(initial=0)))
    return models, max(errors)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    models, error = fit(rows, "v", components)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def measure(column: pa.Array) -> pa.Array:
        deviation: list = [None] * len(column)
        out: list = [None] * len(column)
        for at, x in matrices(column):
            model = sent.value[x.shape[1]]
            values = model.whitened(x)
            for i, v, w in zip(at.tolist(), model.deviation(x), values):
                deviation[i], out[i] = v, w
        return struct_array({"deviation": pa.array(deviation, pa.int64()), "whitened": list_array(out, pa.float64())})

    constant = F.lit(None).cast("struct<n:bigint,explained:array<double>,real:array<boolean>>")
    for d, m in models.items():
        this = F.struct(F.lit(m.n).cast("long").alias("n"), F.array(*[F.lit(e).cast("double") for e in m.explained]).alias("explained"), F.array(*[F.lit(bool(r)) for r in m.real]).alias("real"))
        constant = F.when(F.size("v") == d, this).otherwise(constant)
    found = rows.select("id", constant.alias("fit"), arrow_udf(measure, _WHITENED)(F.col("v")).alias("found"))
    each = found.select("id", "fit", "found.deviation", F.posexplode("found.whitened").alias("i", "w"))
    return each.select("id", (F.col("i") + 1).alias("component"), "fit.n", "deviation", F.when(F.get("fit.real", F.col("i")), F.col("w")).alias("whitened"),
                       F.get("fit.explained", F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
