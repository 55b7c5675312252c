"""Helpers the operators share: table access, registration, words of a text."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASCII_UPPER, ASCII_LOWER = string.ascii_uppercase, string.ascii_lowercase
#: A word: digits, a-z and everything beyond ASCII, after A-Z are lower-cased.
NO_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes(0x20 if b in NO_WORD else b for b in range(256))
#: What separates tokens and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"


def register(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Words of one UTF-8 text: only A-Z are lower-cased, bytes beyond ASCII belong to words."""
    return raw.lower().translate(TO_SPACE).split()


def spare(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as set it apart from all columns."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def marks_of_blocks(docs: DataFrame, text_col: str, blocks: Iterable, marker: Callable, kind: str, label: str) -> tuple[DataFrame, str, DataFrame]:
    """What each of several blocks of search data, too large to be held together, finds in the texts.

    ``marker(block, first)`` turns a list of UTF-8 texts into an Arrow array of ``kind``, null where the block finds
    nothing. Every block is broadcast, passes over the texts in a job of its own that stages its marks, and is
    destroyed before the next one is made, so one block is alive at a time. Given back are the staged
    documents, the name of their number, and the marks (that number, ``mark``) of all blocks."""
    row, context = spare(docs, "row"), docs.sparkSession.sparkContext
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), f"{label}-rows")

    def pass_over(sent, first: bool) -> DataFrame:
        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mark = marker(sent.value, first)
            for batch in batches:
                for at, raw in in_parts(batch.column(1)):
                    found = mark(raw)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), found], ["row", "mark"]).filter(found.is_valid())

        return staged(kept.select(row, text_col).mapInArrow(per_batch, f"row long, mark {kind}"), f"{label}-marks")

    marks = None
    for block in blocks:
        sent = context.broadcast(block)
        part = pass_over(sent, marks is None)
        sent.destroy()
        marks = part if marks is None else marks.unionByName(part)
    return kept, row, marks.withColumnRenamed("row", row)


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``max_rows`` (narrow) rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= max_rows else df


def heaviest(known: DataFrame, weight: str, max_hot: int = 250_000, max_bytes: int = 32 << 20) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of the staged ``known`` whose ``weight`` reaches a power of two, as far as ``max_hot``
    rows and ``max_bytes`` go, and the others; None where one of the two holds no row."""
    text = lambda c: known.schema[c].dataType.simpleString() in ("string", "binary")
    size = sum((F.coalesce(F.length(c), F.lit(0)) if text(c) else F.lit(8) for c in known.columns), F.lit(64))
    rows = known.groupBy(F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)))).alias("level")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    least, n, n_bytes = None, 0, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        n, n_bytes = n + r["n"], n_bytes + r["bytes"]
        if n > max_hot or n_bytes > max_bytes:
            return (None if least is None else known.where(F.col(weight) >= least)), (known if least is None else known.where(F.col(weight) < least))
        least = 2 ** r["level"]
    return known, None


def looked_up(asked: DataFrame, known: DataFrame, key: str, weight: str, max_hot: int = 250_000) -> DataFrame:
    """``asked`` with the columns of ``known`` (one row a key, both staged), null where a key is unknown.

    ``weight`` says how often a key is asked at most. The heaviest keys are broadcast, bounded in
    number and bytes; the others are shuffled, and none of those meets many rows in one task."""
    hot, rest = heaviest(known, weight, max_hot)
    if rest is None:
        return asked.join(F.broadcast(hot), key, "left")
    if hot is None:
        return asked.join(rest, key, "left")
    keys = F.broadcast(hot.select(key))
    return asked.join(F.broadcast(hot), key).unionByName(asked.join(keys, key, "left_anti").join(rest, key, "left"))


def struct_array(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per element of ``parts``."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of items whose sizes add up to about ``most``; a larger item stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def in_parts(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, some megabytes at a time, with the position of the first of each part."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, as_bytes(column.slice(a, b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (uint64 in and out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
