"""Records of delimited files that are read in splits, each on its own.

A quote can reach over any line end, so what a line means depends on whether it starts inside a
quoted cell. Over one split that is a function of two values: where a split ends up if it starts
outside, and where if it starts inside a quoted cell. Lines without a quote leave both as they are.
``entries`` gathers these functions, one row a split, and composes them along each file with
window sums, which tells every split how it starts; ``cut`` then cuts a split into records without seeing
any other. A record that lies across borders comes as fragments, which alone are brought together.

Cells follow the spreadsheet rules: a quote opens a cell only at its start, two quotes inside
stand for one, what follows the closing quote belongs to the cell. Records end at ``\\n``, ``\\r\\n`` and
``\\r`` outside quoted cells; inside them every line end is kept as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Delimiters considered; the first one wins a tie.
DELIMITERS = [",", ";", "\t", "|"]
#: What ``cut`` finds: a whole record, one that goes on in the next split, a split inside one
#: cell, and the end of a record from an earlier split.
RECORD, OPEN, MORE, CLOSE = "record", "open", "more", "close"
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


def delimiter_of(header: str) -> str:
    """The delimiter seen most outside quotes, a comma when there is none."""
    bare = re.sub('"[^"]*"', "", header)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


@functools.cache
def _next_opening(delimiter: str) -> re.Pattern:
    return re.compile(rf'[{re.escape(delimiter)}\r]"|\r')


def walk(line: str, inside: bool, delimiter: str) -> tuple[list[int], bool]:
    """Where records end within a line, and whether the line ends inside a quoted cell."""
    ends, at, opening = [], 0, _next_opening(delimiter)
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            closing = _CLOSING.match(line, at)
            if closing is None:
                return ends, True
            at = closing.end()
        found = opening.search(line, at)
        if found is None:
            return ends, False
        if found[0][0] == "\r":
            ends.append(found.start())
        at, inside = found.end(), found[0][-1] == '"'


def cut(lines: Iterator[str], inside: bool, delimiter: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a split's lines, which end at ``\\n``."""
    held: list[str] = []
    own = not inside
    for line in lines:
        if '"' not in line:
            if inside:
                held.append(line)
                continue
            if "\r" not in line[:-1]:
                yield RECORD, line
                continue
        ends, inside = walk(line, inside, delimiter)
        begin = 0
        for end in ends:
            held.append(line[begin:end])
            yield RECORD if own else CLOSE, "\n".join(held)
            held, own, begin = [], True, end + 1
        if inside or begin < len(line) or not ends:
            held.append(line[begin:])
        if held and not inside:
            yield RECORD if own else CLOSE, "\n".join(held)
            held, own = [], True
    if held:
        yield OPEN if own else MORE, "\n".join(held)


def header_of(lines: Iterator[str]) -> tuple[str, str, str, Iterator[tuple[str, str]]] | None:
    """(first line, delimiter, header record, what follows) of a file's first split: the header is
    the record that starts at the first line that isn't blank. None without one."""
    first = next((x for x in (x.lstrip("\ufeff") for x in lines) if x.strip()), None)
    if first is None:
        return None
    delimiter = delimiter_of(first)
    rest = cut(_with(first, lines), False, delimiter)
    kind, record = next(rest)
    return first, delimiter, record if kind == RECORD else "", rest


def _with(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest


class Function:
    """How a split ends up for each delimiter, from outside and from inside a quoted cell."""

    def __init__(self):
        self.ends = [False, True] * len(DELIMITERS)

    def take(self, line: str) -> None:
        met = {}
        for i, inside in enumerate(self.ends):
            key = DELIMITERS[i // 2], inside
            if key not in met:
                met[key] = walk(line, inside, key[0])[1]
            self.ends[i] = met[key]


def stretches(batches: Iterator[pa.RecordBatch], n_keys: int, decode: bool = True) -> Iterator[tuple[tuple, Iterator]]:
    """(key, values) of consecutive rows with equal keys in the first columns; the last column
    holds the values, texts in UTF-8 (what isn't, is replaced) or bytes."""
    def pieces():
        for batch in batches:
            keys, values = batch.columns[:n_keys], batch.column(n_keys)
            if batch.num_rows and all(len(c.unique()) == 1 for c in keys):
                yield tuple(c[0].as_py() for c in keys), values
                continue
            rows, begin = [c.to_pylist() for c in keys], 0
            same = list(zip(*rows))
            for i in range(1, batch.num_rows + 1):
                if i == batch.num_rows or same[i] != same[begin]:
                    yield same[begin], values.slice(begin, i - begin)
                    begin = i

    state: dict = {"next": None}
    source = pieces()
    state["next"] = next(source, None)
    while state["next"] is not None:
        key = state["next"][0]

        def own():
            while state["next"] is not None and state["next"][0] == key:
                for raw in state["next"][1].cast(pa.binary()).to_pylist():
                    yield raw.decode("utf-8", "replace") if decode and raw is not None else raw
                state["next"] = next(source, None)

        values = own()
        yield key, values
        for _ in values:
            pass


def entries(lines: DataFrame) -> DataFrame:
    """(file, block, inside, delimiter, head) of every split behind a file's first, from (file, block,
    value) in order of each split. ``head`` is the header record, null if there is none."""
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (file, block), values in stretches(batches, 2):
            function, delimiter, head = Function(), None, None
            taken = _noting((v for v in values if v is not None), function)
            if block == 0 and (found := header_of(taken)):
                _, delimiter, head, _ = found
            for _ in taken:
                pass
            rows.append((file, block, function.ends, delimiter, head))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "ends", "delimiter", "head"])

    # Lines without a quote change nothing; only that the split is there has to be known.
    quoted = lines.select("file", "block", F.when((F.col("block") == 0) | F.contains("value", F.lit('"')), F.col("value")).alias("value"))
    found = quoted.mapInArrow(summaries, "file string, block long, ends array<boolean>, delimiter string, head string")
    whole = Window.partitionBy("file").orderBy("block")
    upto, earlier = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow), whole
    k = F.array_position(F.array(*[F.lit(d) for d in DELIMITERS]), F.coalesce("delimiter", F.lit(DELIMITERS[0]))).cast("int") - 1
    known = found.select("file", "block", "ends", *[F.first(c).over(upto).alias(c) for c in ("delimiter", "head")])
    known = known.select("*", F.get("ends", 2 * k).cast("int").alias("out"), F.get("ends", 2 * k + 1).cast("int").alias("in"))
    known = known.withColumn("swaps", F.sum(F.when((F.col("out") == 1) & (F.col("in") == 0), 1).otherwise(0)).over(upto))
    fixed = F.last(F.when(F.col("out") == F.col("in"), F.struct("out", "swaps")), ignorenulls=True).over(upto)
    known = known.withColumn("fixed", fixed)
    ends_inside = F.coalesce(F.col("fixed.out") + F.col("swaps") - F.col("fixed.swaps"), F.col("swaps")) % 2 == 1
    known = known.withColumn("ends_inside", ends_inside)
    return known.withColumn("inside", F.lag("ends_inside").over(earlier)).where("block > 0").select("file", "block", "inside", "delimiter", "head")


def _noting(values: Iterator[str], function: Function) -> Iterator[str]:
    for value in values:
        if '"' in value:
            function.take(value)
        yield value
