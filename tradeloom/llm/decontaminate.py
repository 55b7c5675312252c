"""Benchmark decontamination with an FM-index per training shard.

A window is 13 consecutive words of a benchmark item; an item with fewer words, but not none,
is one window. Every Arrow batch of documents is a shard. Its words are mapped to the alphabet
of the windows, and words outside it separate runs; a run shorter than the shortest window
can't hold one and is left out, everything else is indexed: suffix array by prefix doubling,
its Burrows-Wheeler transform in a wavelet matrix with sampled ranks, and every 8th suffix
position. All windows are searched backwards together, and the rows that remain are followed
to the next sampled position, which locates every occurrence. Overlapping occurrences are
merged into spans for removal.

Defined results: null and empty texts, and items without words, have no words and match
nothing; rows that repeat a doc_id or an item_id are judged by themselves, a repeated item
counts once; an item whose id is null is named by an empty string; empty tables give empty
results or no hits; very long texts are cut into overlapping runs of at most ``SHARD_WORDS``,
so an index stays small and no occurrence is lost; other columns are not read. The windows are
sent to the tasks in blocks of at most ``block_words`` benchmark words, whatever the size of
the benchmark. Where there are several, each has a job of its own over the staged texts, which stages what
it finds, and is destroyed before the next block is made; the findings of a row are merged at the end.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tradeloom.llm.common import as_bytes, in_parts, list_array, marks_of_blocks, slices, struct_array, words_of

WIDTH = 13
SHARD_WORDS = 1 << 18
SAMPLE = 8
_KIND = "struct<n_words:bigint,items:array<string>,starts:array<int>,ends:array<int>>"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Wavelet:
    """Wavelet matrix of small non-negative numbers: rank of a symbol before a position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, current = [], symbols
        for b in range(bits - 1, -1, -1):
            bit = (current >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            zeros = len(current) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out, i = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            one = ones[i + 1] - ones[i]
            out |= one.astype(at.dtype) << b
            i = np.where(one == 1, zeros + ones[i], i - ones[i])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a suffix that ends first comes first."""
    n, rank, width = len(s), np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of one sequence over the alphabet 1..k; 0 separates runs. Inside, all symbols are
    one higher, so that the end of the sequence has a symbol of its own."""

    def __init__(self, s: np.ndarray):
        s = np.concatenate([s + 1, [0]]).astype(np.int64)
        order = suffix_array(s)
        self.n = len(s)
        last = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.tree = Wavelet(last, max(1, int(s.max()).bit_length()))
        kept = order % SAMPLE == 0
        self.before = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each row of ``pattern`` (all of one width)."""
        pattern = pattern + 1
        low, high = np.zeros(len(pattern), dtype=np.int64), np.full(len(pattern), self.n, dtype=np.int64)
        live = np.flatnonzero((pattern < len(self.first) - 1).all(axis=1))
        dead = np.ones(len(pattern), dtype=bool)
        dead[live] = False
        for j in range(pattern.shape[1] - 1, -1, -1):
            c = pattern[live, j]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
            out = low[live] >= high[live]
            dead[live[out]] = True
            live = live[~out]
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each row steps back through the text to a sampled one."""
        at, steps, found = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            i = at[live]
            hit = self.before[i + 1] > self.before[i]
            found[live[hit]] = self.sampled[self.before[i[hit]]] + steps[live[hit]]
            live, i = live[~hit], i[~hit]
            c = self.tree.access(i)
            at[live] = self.first[c] + self.tree.rank(c, i)
            steps[live] += 1
        return found


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def search_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_words`` words."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (5 * block_words)))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [rows.where(part == i) for i in range(n)]


def phrases_of(rows: list, width: int = WIDTH) -> dict:
    """Alphabet and distinct windows, by width, with the items each belongs to."""
    alphabet: dict[bytes, int] = {}
    found: dict[tuple, set[str]] = defaultdict(set)
    for r in rows:
        for w in windows_of(words_of((r["text"] or "").encode()), width):
            found[tuple(alphabet.setdefault(x, len(alphabet) + 1) for x in w)].add(r["id"] or "")
    by_width = defaultdict(list)
    for w, items in found.items():
        by_width[len(w)].append((w, sorted(items)))
    return {"alphabet": alphabet, "windows": [(np.array([w for w, _ in ws], dtype=np.int64), [i for _, i in ws]) for ws in by_width.values()]}


def runs_of(ids: np.ndarray, shortest: int, longest: int) -> list[tuple[int, int]]:
    """Stretches of known words that could hold a window, cut with an overlap where they are long."""
    edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= shortest:
            for i in range(a, max(a + 1, b - longest + 1), SHARD_WORDS):
                out.append((i, min(b, i + SHARD_WORDS + longest - 1)))
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, adjoining ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]


def occurrences(docs: list[np.ndarray], phrases: dict) -> dict[int, list[tuple[int, int, list[str]]]]:
    """(first word, behind the last word, items) of every window in every document of a batch."""
    found: dict[int, list] = defaultdict(list)
    if not phrases["windows"]:
        return found
    widths = [w.shape[1] for w, _ in phrases["windows"]]
    runs = [(d, a, b) for d, ids in enumerate(docs) for a, b in runs_of(ids, min(widths), max(widths))]
    for first, behind in slices([b - a + 1 for _, a, b in runs], SHARD_WORDS):
        part = runs[first:behind]
        at = np.cumsum([0] + [b - a + 1 for _, a, b in part])
        index = FMIndex(np.concatenate([np.append(docs[d][a:b], 0) for d, a, b in part]))
        for pattern, items in phrases["windows"]:
            low, high = index.search(pattern)
            which = np.repeat(np.arange(len(pattern)), high - low)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            for w, p in zip(which.tolist(), index.locate(rows).tolist()):
                run = int(np.searchsorted(at, p, "right")) - 1
                d, a, _ = part[run]
                begin = a + p - int(at[run])
                found[d].append((begin, begin + pattern.shape[1], items[w]))
    return found


def searched(raws: list[bytes], phrases: dict) -> tuple[list[int], list[list[str]], list[np.ndarray], list[np.ndarray]]:
    """Number of words, items, and merged spans of each text."""
    docs, n_words, code = [], [], phrases["alphabet"].get
    for raw in raws:
        words = words_of(raw)
        n_words.append(len(words))
        docs.append(np.fromiter((code(w, 0) for w in words), dtype=np.int32, count=len(words)))
    found, items, spans = occurrences(docs, phrases), [], []
    for d in range(len(docs)):
        hits = found.get(d, [])
        items.append(sorted({i for h in hits for i in h[2]}))
        spans.append(merged(np.array([h[0] for h in hits], dtype=np.int32), np.array([h[1] for h in hits], dtype=np.int32)))
    return n_words, items, [a for a, _ in spans], [b for _, b in spans]


def found_array(n_words: list[int], items: list[list[str]], starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.StructArray:
    return struct_array({"n_words": pa.array(n_words, pa.int64()), "items": pa.array(items, pa.list_(pa.string())),
                         "starts": list_array(starts, pa.int32()), "ends": list_array(ends, pa.int32())})


def searcher(sent):
    def search(texts: pa.Array) -> pa.Array:
        parts = [searched(part, sent.value) for _, part in in_parts(texts)]
        return found_array(*([x for p in parts for x in p[i]] for i in range(4)))

    return search


def block_searcher(phrases: dict, first: bool):
    """The first block reports every text, the others those in which they find something."""
    def search(raws: list[bytes]) -> pa.Array:
        got = searched(raws, phrases)
        all_ = found_array(*got)
        return all_ if first else pc.if_else(pa.array([bool(i) for i in got[1]], pa.bool_()), all_, pa.scalar(None, all_.type))

    return search


def joined_spans(starts: pa.Array, ends: pa.Array) -> pa.Array:
    spans = [merged(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)) for a, b in zip(starts.to_pylist(), ends.to_pylist())]
    return struct_array({"starts": list_array([a for a, _ in spans], pa.int32()), "ends": list_array([b for _, b in spans], pa.int32())})


def with_contamination(docs: DataFrame, benchmark: DataFrame, name: str = "found", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       block_words: int = 2_000_000) -> DataFrame:
    """``docs`` and a column struct<n_words, items, starts, ends> called ``name``: the items found and
    the merged spans of their words."""
    parts = search_blocks(benchmark, item_col, item_text_col, block_words)
    if len(parts) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(phrases_of(parts[0].collect()))
        return docs.withColumn(name, arrow_udf(searcher(sent), _KIND)(F.col(text_col)))
    blocks = (phrases_of(part.collect()) for part in parts)
    kept, row, marks = marks_of_blocks(docs, text_col, blocks, block_searcher, _KIND, "contamination")
    listed = lambda field: F.flatten(F.collect_list(f"mark.{field}")).alias(field)
    of_row = marks.groupBy(row).agg(F.max("mark.n_words").alias("n_words"), listed("items"), F.collect_list("mark").alias("marks"))
    spans = arrow_udf(joined_spans, "struct<starts:array<int>,ends:array<int>>")(F.flatten("marks.starts"), F.flatten("marks.ends"))
    of_row = of_row.select(row, "n_words", F.array_sort(F.array_distinct("items")).alias("items"), spans.alias("s"))
    return kept.join(of_row.select(row, F.struct("n_words", "items", "s.starts", "s.ends").alias(name)), row).select(*docs.columns, name)


def n_hit(found: str) -> Column:
    """Words inside the spans of a contamination column."""
    spans = F.zip_with(f"{found}.starts", f"{found}.ends", lambda a, b: (b - a).cast("long"))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)


def is_contaminated(found: str) -> Column:
    """Words are hit, and they are at least a twentieth of all."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def without_spans(docs: DataFrame, found: str, text_col: str = "text") -> Column:
    """The text without the words of the spans and what stands between them."""
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, s in zip(as_bytes(texts), spans.to_pylist()):
            if s and s["starts"]:
                at = [m.span() for m in _WORD.finditer(raw.lower())]
                kept, last = [], 0
                for a, b in zip(s["starts"], s["ends"]):
                    kept.append(raw[last:at[a][0]])
                    last = at[b - 1][1]
                raw = b"".join([*kept, raw[last:]])
            out.append(raw)
        return pa.array(out, pa.binary()).cast(pa.string())

    return arrow_udf(cut, "string")(F.col(text_col), F.col(found))
