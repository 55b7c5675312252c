"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counted from the whole text, a batch of texts at a time. Training uses at
most ``max_rows`` labelled rows (those with the smallest hash of their id, so reruns and any
partitioning choose the same) on the driver: features are cut into at most 64 bins, and each
tree grows leaf-wise from gradient histograms. Trees are flattened into arrays of feature,
threshold and children, and all rows of a batch walk all levels at once in numpy.

Defined results: a null or empty text has no words and is scored like any other; labels other
than 0 and 1 and null labels are left out; if no rows are labelled the score is 0.5, if all
have one label it is that label's rate, smoothed; repeated labelled rows count repeatedly; an
empty table gives an empty result. The input's further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tradeloom.llm.common import in_parts, slices

FEATURES = ("log_words", "log_bytes", "mean_word", "distinct_words", "immediate_repeats", "top_word_share", "upper_share", "letter_share", "digit_share",
            "blank_share", "mark_share", "strong_mark_share", "pipe_share", "words_with_mark_tail", "doubled_marks", "lines", "mean_line", "distinct_lines",
            "stop_mark_lines", "distinct_trigrams", "longest_word", "short_word_share", "capital_word_share", "line_spread")
_STRONG = np.frombuffer(b"!?#$%&*@^~+=", dtype=np.uint8)
_END = (b".", b"!", b"?", b'"', b"'", b":", b")")
_TAIL = frozenset(b"!#$%&*@^~+=|")


def statistics(raw: bytes) -> list[float]:
    """The features of one UTF-8 text, in the order of ``FEATURES``."""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    lower, upper, digits = counts[97:123].sum() + counts[128:].sum(), counts[65:91].sum(), counts[48:58].sum()
    blanks = counts[32] + counts[9:14].sum()
    vocabulary: dict[bytes, int] = {}
    for x in words:
        vocabulary[x] = vocabulary.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    line_sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sizes.mean() if len(words) else 0.0, len(vocabulary) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, max(vocabulary.values(), default=0) / w, upper / n, (lower + upper) / n, digits / n,
        blanks / n, (n - lower - upper - digits - blanks) / n, counts[_STRONG].sum() / n, counts[124] / n, sum(x[-1] in _TAIL for x in words) / w,
        (raw.count(b"!!") + raw.count(b"##") + raw.count(b"$$") + raw.count(b"**") + raw.count(b"..")) / w, np.log1p(len(lines)), line_sizes.mean(), len(set(lines)) / len(lines),
        sum(x.endswith(_END) for x in lines) / len(lines), len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2), sizes.max(initial=0),
        (sizes <= 3).sum() / w, sum(65 <= x[0] <= 90 for x in words) / w, line_sizes.std() / (1 + line_sizes.mean()),
    ]


def matrix_of(texts: pa.Array) -> np.ndarray:
    """The features of a batch of texts, a row each."""
    rows = [statistics(x) for _, part in in_parts(texts) for x in part]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


def feature_column(text_col: str = "text") -> Column:
    def measure(texts: pa.Array) -> pa.Array:
        values = matrix_of(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))

    return arrow_udf(measure, "array<double>")(F.col(text_col))


class Forest:
    """Trees as flat arrays: inner nodes compare a feature with a threshold, leaves add a value."""

    def __init__(self, base: float, trees: list[dict[str, np.ndarray]]):
        self.base, self.depth = base, max([t["depth"] for t in trees], default=0)
        offsets = np.cumsum([0] + [len(t["feature"]) for t in trees])
        join = lambda k, kind: np.concatenate([t[k] for t in trees]).astype(kind) if trees else np.zeros(0, kind)
        self.feature, self.threshold, self.value = join("feature", np.int32), join("threshold", np.float64), join("value", np.float64)
        self.left = np.concatenate([t["left"] + o for t, o in zip(trees, offsets)]).astype(np.int32) if trees else np.zeros(0, np.int32)
        self.right = np.concatenate([t["right"] + o for t, o in zip(trees, offsets)]).astype(np.int32) if trees else np.zeros(0, np.int32)
        self.roots = offsets[:-1].astype(np.int32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a, b in slices([len(self.roots) or 1] * len(x), 1 << 18):
            at, part = np.tile(self.roots, (b - a, 1)), x[a:b]
            for _ in range(self.depth):
                inside = np.take_along_axis(part, self.feature[at], axis=1) <= self.threshold[at]
                at = np.where(inside, self.left[at], self.right[at])
            out[a:b] += self.value[at].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, leaves: int, depth: int, least: float, smooth: float, rate: float) -> tuple[dict, np.ndarray]:
    """One tree, best leaf first; also what it adds to each training row."""
    n_bins = max(len(e) + 1 for e in edges)
    k = binned.shape[1]
    shifted = binned + np.arange(k) * n_bins

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        flat = shifted[rows].ravel()
        hist = lambda v: np.bincount(flat, np.repeat(v[rows], k), minlength=k * n_bins).reshape(k, n_bins).cumsum(axis=1)
        gl, hl = hist(g), hist(h)
        gt, ht = g[rows].sum(), h[rows].sum()
        gain = gl ** 2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt ** 2 / (ht + smooth)
        gain[(hl < least) | (ht - hl < least)] = -1.0
        at = int(np.argmax(gain))
        return float(gain.flat[at]), at // n_bins, at % n_bins

    feature, threshold, left, right, value = [0], [np.inf], [0], [0], [0.0]
    everything = np.arange(len(binned))
    open_ = [(best(everything), 0, 0, everything)]
    closed, deepest = [], 0
    while open_:
        i = max(range(len(open_)), key=lambda j: (open_[j][0][0], -open_[j][1]))
        (gain, f, cut), node, level, rows = open_.pop(i)
        if gain <= 1e-6 or level >= depth or len(open_) + len(closed) + 2 > leaves:
            closed.append((node, rows))
            continue
        below = binned[rows, f] <= cut
        feature[node], threshold[node] = f, edges[f][cut] if cut < len(edges[f]) else np.inf
        for side, part in ((left, rows[below]), (right, rows[~below])):
            side[node] = len(feature)
            for column, x in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
                column.append(x)
            left[-1] = right[-1] = side[node]
            open_.append((best(part), side[node], level + 1, part))
        deepest = max(deepest, level + 1)
    added = np.zeros(len(binned))
    for node, rows in closed:
        value[node] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
        added[rows] = value[node]
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right), "value": np.array(value), "depth": deepest}, added


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, leaves: int = 16, depth: int = 6, bins: int = 64, rate: float = 0.2, least: float = 2.0, smooth: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1 with logistic loss."""
    if not len(y):
        return Forest(0.0, [])
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Forest(base, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        tree, added = grow(binned, edges, p - y, p * (1 - p), leaves, depth, least, smooth, rate)
        made.append(tree)
        margin += added
    return Forest(base, made)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Forest:
    """A forest from at most ``max_rows`` labelled rows; statistics are counted for them alone.
    The chosen ids are broadcast: two numbers a row, and ``max_rows`` bounds the rows."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    got = rows.select("_id", "_label", feature_column("_text").alias("x")).toPandas().sort_values(["_id", "_label"], kind="stable")
    if not len(got):
        return Forest(0.0, [])
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort(x.T)
    return fit(x[order], got["_label"].to_numpy(dtype=np.float64)[order])


def score_column(docs: DataFrame, forest: Forest, text_col: str = "text") -> Column:
    """The score of each row's text, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(matrix_of(texts)), pa.float64())

    return arrow_udf(score, "double")(F.col(text_col))
