"""Line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

The reference-count table (``h1``, ``h2``, ``n``) holds for every line key the number of
documents that contain it. It is exact and can be updated: ``merge_refs`` adds the counts of
inserted documents and subtracts those of deleted ones, so a line that falls below the limit
again comes back. The frequent keys of each shard go into a cuckoo filter of 16-bit
fingerprints; ``update_filters`` inserts and deletes only the keys that crossed the limit.
While a filter is built, all other keys of its shard are probed too, and the few that hit by
chance are stored next to it: for every line the table has counted, the answer is exact.

A key is a line with blanks stripped at both ends and A-Z lower-cased, identified by 128 bits
of BLAKE2b.

Defined results: a null or empty text is one empty line; empty keys are never dropped; every
row counts as a document, repeated rows too; no documents give an empty table and filters
that hold nothing; further columns of the input are never looked at. Texts of any length are
handled line by line. Filters are sent to the tasks in blocks of at most ``block_bytes``. Where there are
several, each has a job of its own over the staged texts, which stages its marks, and is destroyed before
the next one is sent, so what a task holds doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tradeloom.llm.common import BLANKS, in_parts, marks_of_blocks, mix, spare, struct_array
from tradeloom.staging import staged

SLOTS = 4
_REFS = "h1 long, h2 long, n long"
_FILTERS = "shard long, n_shards long, slots binary, chance binary"
_DROPS = "struct<n_lines:bigint,n_dropped:bigint,kept:string>"


def keys_of(raw: bytes) -> list[bytes]:
    blanks = BLANKS.encode()
    return [line.strip(blanks) for line in raw.lower().split(b"\n")]


def key_hash(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit halves per key, as an array of shape (n, 2)."""
    raw = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys)
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def count_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Reference counts of all line keys with at least ``min_chars`` code points."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raws in in_parts(batch.column(0)):
                seen: Counter[bytes] = Counter()
                for raw in raws:
                    seen.update({k for k in keys_of(raw) if len(k) >= min_chars and len(k.decode()) >= min_chars})
                h = key_hash(list(seen))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    return docs.select(text_col).mapInArrow(per_batch, _REFS).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def merge_refs(refs: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Counts after documents came and went; ``inserted`` and ``deleted`` are their counts."""
    parts = refs
    if inserted is not None:
        parts = parts.unionByName(inserted)
    if deleted is not None:
        parts = parts.unionByName(deleted.withColumn("n", -F.col("n")))
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 0")


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, SLOTS)

    @staticmethod
    def of(h: np.ndarray) -> Cuckoo:
        n = 1
        while n * SLOTS * 0.85 < len(h):
            n *= 2
        while True:
            made = Cuckoo(np.zeros(n * SLOTS, dtype=np.uint16))
            if all(made.insert(*x) for x in made.places(h)):
                return made
            n *= 2

    def places(self, h: np.ndarray) -> list[tuple[int, int]]:
        print_, first, _ = self.locate(h)
        return list(zip(print_.tolist(), first.tolist()))

    def other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def locate(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = h.view(np.uint64) if h.dtype != np.uint64 else h
        print_ = np.maximum(u[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
        first = (mix(u[:, 0].copy()) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return print_, first, self.other(print_, first)

    def insert(self, print_: int, bucket: int) -> bool:
        for at in (bucket, int(self.other(np.array([print_]), np.array([bucket]))[0])):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = print_
                return True
        for kick in range(500):
            slot = (kick * 7 + print_) % SLOTS
            print_, self.slots[at, slot] = int(self.slots[at, slot]), print_
            at = int(self.other(np.array([print_]), np.array([at]))[0])
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = print_
                return True
        return False

    def delete(self, print_: int, bucket: int) -> bool:
        for at in (bucket, int(self.other(np.array([print_]), np.array([bucket]))[0])):
            held = np.flatnonzero(self.slots[at] == print_)
            if len(held):
                self.slots[at, held[0]] = 0
                return True
        return False

    def holds(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, dtype=bool)
        print_, first, second = self.locate(h)
        return ((self.slots[first] == print_[:, None]) | (self.slots[second] == print_[:, None])).any(axis=1)


def pairs(pdf: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(dtype=np.int64)).reshape(-1, 2)


def stored(shard: int, n_shards: int, cuckoo: Cuckoo, rare: np.ndarray) -> pd.DataFrame:
    chance = rare[cuckoo.holds(rare)]
    return pd.DataFrame({"shard": [shard], "n_shards": [n_shards], "slots": [cuckoo.slots.tobytes()], "chance": [chance.tobytes()]})


def build_filters(refs: DataFrame, min_docs: int, keys_per_shard: int = 200_000) -> DataFrame:
    """One filter per shard of the keys found in at least ``min_docs`` documents."""
    n_shards = max(1, -(-refs.count() // keys_per_shard))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, often = pairs(pdf), (pdf["n"] >= min_docs).to_numpy()
        return stored(int(key[0]), n_shards, Cuckoo.of(h[often]), h[~often])

    return refs.groupBy(F.pmod("h1", F.lit(n_shards)).alias("shard")).applyInPandas(build, _FILTERS)


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    """Filters after the counts went from ``before`` to ``after``: keys that rose to the limit
    are inserted, keys that fell below it are deleted. A filter that gets too full is rebuilt."""
    shards = filters.agg(F.max("n_shards")).first()[0] or 1
    shard = F.pmod("h1", F.lit(shards))
    old = before.select("h1", "h2", F.col("n").alias("was"))
    both = after.join(old, ["h1", "h2"], "full").select(
        shard.alias("shard"), "h1", "h2", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("was", F.lit(0)).alias("was"))

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = int(left["shard"].iloc[0] if len(left) else right["shard"].iloc[0])
        h, now, was = pairs(right), (right["n"] >= min_docs).to_numpy(), (right["was"] >= min_docs).to_numpy()
        cuckoo = Cuckoo(np.frombuffer(left["slots"].iloc[0], dtype=np.uint16).copy()) if len(left) else Cuckoo.of(h[was])
        for x in cuckoo.places(h[was & ~now]):
            cuckoo.delete(*x)
        if not all(cuckoo.insert(*x) for x in cuckoo.places(h[now & ~was])):
            cuckoo = Cuckoo.of(h[now])
        return stored(at, shards, cuckoo, h[~now])

    return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(change, _FILTERS)


def blocks_of(filters: DataFrame, block_bytes: int) -> Iterator[dict]:
    """Filters of consecutive shards, a bounded number of bytes at a time."""
    size = F.length("slots") + F.length("chance") + 64
    largest, total, shards = filters.agg(F.max(size), F.sum(size), F.max("n_shards")).first()
    if not shards:
        yield {"n_shards": 1, "filters": {}}
        return
    step = max(1, block_bytes // max(largest, 1))
    for begin in range(0, shards, step if total > block_bytes else shards):
        end = begin + step if total > block_bytes else shards
        rows = filters.where(F.col("shard").between(begin, end - 1)).collect()
        yield {"n_shards": shards, "filters": {r["shard"]: (bytes(r["slots"]), bytes(r["chance"])) for r in rows}}


def frequent(h: np.ndarray, block: dict) -> np.ndarray:
    """Which keys the shards of this block hold."""
    out, shard = np.zeros(len(h), dtype=bool), h[:, 0] % block["n_shards"]
    for s in np.unique(shard):
        if (held := block["filters"].get(int(s))) is None:
            continue
        at = np.flatnonzero(shard == s)
        hit = at[Cuckoo(np.frombuffer(held[0], dtype=np.uint16)).holds(h[at])]
        chance = {held[1][i:i + 16] for i in range(0, len(held[1]), 16)}
        out[[i for i in hit if h[i].tobytes() not in chance] if chance else hit] = True
    return out


def line_marks(raws: list[bytes], block: dict, min_chars: int) -> list[list[bool]]:
    """For every line of every text: does a filter of this block hold its key?"""
    keys = [keys_of(x) for x in raws]
    index: dict[bytes, int] = {}
    for ks in keys:
        for k in ks:
            if len(k) >= min_chars and k not in index and len(k.decode()) >= min_chars:
                index[k] = len(index)
    often = frequent(key_hash(list(index)), block)
    return [[k in index and bool(often[index[k]]) for k in ks] for ks in keys]


def without_marked(raws: list[bytes], marks: list[list[bool]]) -> pa.Array:
    kept = [b"\n".join(x for x, g in zip(raw.split(b"\n"), gone) if not g) if any(gone) else raw for raw, gone in zip(raws, marks)]
    return struct_array({"n_lines": pa.array([len(g) for g in marks], pa.int64()), "n_dropped": pa.array([sum(g) for g in marks], pa.int64()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def drop_lines(docs: DataFrame, filters: DataFrame, name: str = "found", text_col: str = "text", min_chars: int = 1, block_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` and a column struct<n_lines, n_dropped, kept> called ``name``: the text without the
    lines that the (staged) filters hold."""
    blocks = blocks_of(filters, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def drop(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([without_marked([], []), *(without_marked(raw, line_marks(raw, sent.value, min_chars)) for _, raw in in_parts(texts))])

        return docs.withColumn(name, arrow_udf(drop, _DROPS)(F.col(text_col)))

    def marker(held: dict, first: bool):
        def mark(raws: list[bytes]) -> pa.Array:
            return pa.array([bytes(gone) if any(gone) else None for gone in line_marks(raws, held, min_chars)], pa.binary())

        return mark

    def drop_marked(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = [without_marked([], [])]
        for at, raws in in_parts(texts):
            of_row = marks.slice(at, len(raws)).to_pylist()
            out.append(without_marked(raws, [[any(m) for m in zip(*found)] if found else [False] * (raw.count(b"\n") + 1) for raw, found in zip(raws, of_row)]))
        return pa.concat_arrays(out)

    kept, row, marks = marks_of_blocks(docs, text_col, chain([block, following], blocks), marker, "binary", "lines")
    found = spare(kept, name)
    marked = kept.join(marks.groupBy(row).agg(F.collect_list("mark").alias(found)), row, "left")
    return marked.select(*docs.columns, arrow_udf(drop_marked, _DROPS)(F.col(text_col), F.col(found)).alias(name))


def frequent_line_filters(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Staged filters of a corpus in one call."""
    refs = staged(count_lines(docs, text_col, min_chars), "line-refs")
    return staged(build_filters(refs, min_docs), "line-filters")
