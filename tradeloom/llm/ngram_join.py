"""Similarity join of documents on their sets of word n-grams, by MinHash banding.

1. Every text becomes the set of its 5-word shingles, a 128-bit name of that set, and the
   hashes of its signature's bands. Texts with the same set form one class of copies, which is
   a single node from here on: copies are counted, never paired.
2. ``banding`` picks rows and bands so that a pair at the threshold meets in some band with
   the wanted probability. Nodes are shuffled on their band hashes; a bucket links its members
   to its smallest one (a star, so a bucket of any size gives one row a member), and connected
   nodes form a cluster.
3. Within a cluster every pair is verified on the full sets. Clusters are cut into blocks of
   about ``BLOCK`` nodes and a task gets two blocks, so no task holds a large group; it counts
   in numpy and returns one row a node: how many documents it is linked to, and one linked
   node that spans its part. Pairs are never written as rows.

The result has one row per document: ``class_id`` (smallest id of the documents connected by
links), ``copy_id`` (smallest id with the same set) and ``n_links`` (other documents with a
similarity of at least the threshold, copies included).

Defined results: a text of fewer than 5 words, but not none, is one shingle; a text without
words, null or empty, is linked to nothing; rows that repeat an id are documents of their own
and count as copies if their texts agree; null ids sort first and are kept; an empty table
gives an empty table; other columns are not read. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import NO_WORD, in_parts, mix, slices, small
from tradeloom.llm.components import components
from tradeloom.staging import staged

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 144
BLOCK, BIN = 1024, 512
_ODD = 0x9E3779B97F4A7C15


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within the hashes allowed."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    up, down = np.full(n, _ODD, dtype=np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of the word n-grams of each text."""
    word_byte = np.ones(256, dtype=bool)
    word_byte[list(NO_WORD)] = False
    byte_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    out: list[np.ndarray] = []
    for a, b in slices([len(x) + 1 for x in texts], 1 << 20):
        part = [x.lower() for x in texts[a:b]]
        at = np.cumsum([0] + [len(x) + 1 for x in part])
        raw = np.frombuffer(b" ".join([*part, b""]), dtype=np.uint8)
        up, down = powers(len(raw) + 1)
        edge = np.diff(np.concatenate([[0], word_byte[raw].view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_value[raw] * up[:-1], dtype=np.uint64)])
        word = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        doc = np.searchsorted(at, begin, "right") - 1
        n_words = np.bincount(doc, minlength=len(part))
        n = max(0, len(word) - width + 1)
        gram = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            gram = gram * np.uint64(_ODD) + word[j:j + n]
        gram, first = mix(gram), np.concatenate([[0], np.cumsum(n_words)])
        for d in range(len(part)):
            i, k = int(first[d]), int(n_words[d])
            if k >= width:
                out.append(np.unique(gram[i:i + k - width + 1]))
            elif k:
                short = np.uint64(k)
                with np.errstate(over="ignore"):
                    for w in word[i:i + k]:
                        short = short * np.uint64(_ODD) + w
                out.append(mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the set's MinHash signature."""
    k = bands * rows
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(_ODD))
    times, plus = (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (times[:, None] * x[None, i:i + 4096] + plus[:, None]).min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mix(out * np.uint64(_ODD) + column.astype(np.uint64))
    return out.view(np.int64)


def set_name(s: np.ndarray) -> tuple[int, int]:
    two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(two[0]), int(two[1])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """(id, h1, h2, bands) of every row; h1 and h2 are null where a text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_parts(batch.column(1)):
                sets = shingle_sets(texts, width)
                names = [set_name(s) if len(s) else (None, None) for s in sets]
                signed = np.concatenate([band_hashes(s, bands, rows) if len(s) else np.zeros(bands, np.int64) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(signed, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), lists], ["id", "h1", "h2", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(per_batch, f"id {kind}, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The sets of one document of every node of ``members`` (node, cluster, n_blocks, copies, rep, h1, h2).

    Texts of other documents aren't shuffled as long as the wanted ids are few enough to broadcast."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = small(members.select("rep"), 2_000_000)
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    rows = texts.join(members, F.col("id").eqNullSafe(F.col("rep"))).select("text", "h1", "h2", "node", "cluster", "n_blocks", "copies")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_parts(batch.column(0)):
                part, sets = batch.slice(first, len(texts)), shingle_sets(texts, width)
                h1, h2 = part.column(1).to_pylist(), part.column(2).to_pylist()
                # Rows that repeat an id may hold another text; the node's own is known by its name.
                same = [i for i, s in enumerate(sets) if len(s) and set_name(s) == (h1[i], h2[i])]
                kept = part.select(["node", "cluster", "n_blocks", "copies"]).take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([sets[i].tobytes() for i in same], pa.binary())], [*kept.schema.names, "shingles"])

    return rows.mapInArrow(per_batch, "node long, cluster long, n_blocks int, copies long, shingles binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets. Elements of many sets are counted by a
    product of 0/1 matrices, rare ones by the few pairs they occur in."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32)
    common = often > 24
    column = np.cumsum(common) - 1
    dense = common[code]
    rows, cols = owner[dense], column[code[dense]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for c in range(0, int(common.sum()), 2048):
        a, b = np.searchsorted(cols, [c, c + 2048])
        m = np.zeros((n, min(2048, int(common.sum()) - c)), dtype=np.float32)
        m[rows[a:b], cols[a:b] - c] = 1.0
        out += m @ m.T
    rare = ~dense & (often[code] > 1)
    code, owner = code[rare], owner[rare]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for k in np.unique(often[(often > 1) & ~common]):
        group = owner[often[code] == k].reshape(-1, k)
        for i in range(k):
            for j in range(k):
                if i != j:
                    np.add.at(out, (group[:, i], group[:, j]), 1.0)
    return out


def verified(nodes: np.ndarray, blocks: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool) -> pd.DataFrame:
    """(node, other, links) of the nodes with a link: documents linked to, and a node of the same part."""
    ratio, n = Fraction(threshold).limit_denominator(1_000_000), len(nodes)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = intersections(sets).astype(np.int64)
    alike = both * ratio.denominator >= ratio.numerator * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(alike, False)
    if across:
        alike &= blocks[:, None] != blocks[None, :]
    linked, part = alike.any(axis=1), np.arange(n)
    while True:
        lower = np.minimum(part, np.where(alike, part[None, :], n).min(axis=1))
        if (lower == part).all():
            break
        part = lower
    return pd.DataFrame({"node": nodes[linked], "other": nodes[part[linked]], "links": (alike @ copies)[linked]})


def verify(pieces: DataFrame, threshold: float, n_bins: int) -> DataFrame:
    """Counts of every cluster's links, two blocks of a cluster at a time; small clusters share a task."""
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    placed = pieces.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    bin_ = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(n_bins))).otherwise(-1 - F.col("cluster"))
    placed = placed.select("node", "cluster", "copies", "shingles", "block", bin_.alias("bin"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")]
        for _, own in pdf.drop_duplicates("node").groupby("cluster", sort=False):
            if len(own) > 1:
                own = own.sort_values("node")
                sets = [np.frombuffer(x, dtype=np.uint64) for x in own["shingles"]]
                found.append(verified(own["node"].to_numpy(), own["block"].to_numpy(), own["copies"].to_numpy(), sets, threshold, key[1] != key[2]))
        return pd.concat(found)

    return placed.groupBy("bin", "i", "j").applyInPandas(kernel, "node long, other long, links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """(id, class_id, copy_id, n_links) of every row."""
    bands, rows = banding(threshold, recall)
    prints = staged(fingerprints(docs, id_col, text_col, bands, rows, width), "fingerprints")
    sets = prints.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = staged(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    clusters = staged(components(buckets.join(heads, "bucket").where("node != head").select("node", "head"), "node", "head"), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    members = clusters.join(sizes, "component").withColumnRenamed("component", "cluster").join(nodes.drop("bands"), "node")
    pieces = full_sets(docs, staged(members, "members"), id_col, text_col, width)
    links = staged(verify(pieces, threshold, max(1, -(-clusters.count() // BIN))), "links")
    groups = components(links.select("node", "other"), "node", "other")
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "h1", "h2", "rep", "copies").join(totals, "node", "left").join(groups, "node", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "node")), "linked-nodes")
    named = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    by_set = known.join(named, "component").select("h1", "h2", "class_id", F.col("rep").alias("copy_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = F.col("h1").isNull()
    return prints.drop("bands").join(by_set, ["h1", "h2"], "left").select(
        "id", F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
