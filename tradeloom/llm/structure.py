r"""Repair of conversation structure over a suffix-shared automaton.

A row is blank (no character besides ``[\x20\x09-\x0D]``), a duplicate (its conversation holds
its role and text before) or truncated (its last such character is not one of ``.!?``); its first
fault counts. Each row becomes one symbol, its role's initial (s, u, a, other) and fault, and a
conversation a string of symbols, its signature. The cheapest edits that make the role initials
``(s?(ua)+)?`` are asked for: keep (0), rerole to user or assistant (2), delete (3, required for
blank and duplicate rows), insert a user or assistant row without text (2), and 1 for each truncated
row that stays. Of equally cheap edits the one whose initials D, I, K, R are least wins.

What is to be done from a row on depends on the symbols from there to the end and on the grammar
state, so signatures share an automaton whose nodes are the distinct suffixes. Distinct signatures
are range-partitioned and sorted by their reversal, and neighbours have their common suffix in
common: a task keeps the nodes of one signature on a stack, and builds and solves a node - cost to
go, next edit and next state for each grammar state - when it first meets it. Each is solved once
(at a border between tasks the few nodes of one signature once more), and memory holds one
signature. At a node the edits to choose from have different initials, so an edit and a link to the
next node stand for the whole best audit suffix.

Signatures are made from narrow rows (a digest stands for role and text), in one pass in order of
turns; the texts are shuffled once, together with their conversation's audit, and streamed into a
running digest. A conversation may have any number of rows: a task holds one byte a row of it.

Defined results: null roles and texts are one space; rows of a null conv_id are one conversation;
rows go by turn, nulls first, ties by the SHA-256 of role and text, so repeated rows are neighbours;
an initial is the role's first character, and roles with other initials than s, u and a have to be
rerolled or deleted; a conversation without rows has zeros, an empty audit and the hash of an
empty string; gaps that no long holds are null; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.llm.common import BLANKS, looked_up
from tradeloom.staging import staged

#: Grammar states: nothing yet, behind the system row, behind a user, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row with each initial, where the grammar lets it stand.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that can be inserted or given in each state, and the state behind it.
WANTED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_NEVER = 1 << 60
_MEASURED = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
_SOLVED = "signature string, weight long, cost long, audit string"
MEASURES = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), pa.int64()), "signature": pa.string()}
_REPAIRED = "conv {conv}, repaired_sha256 string"


def with_inserts(options: list[tuple[int, str, int]]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Cost to go and next step of each state, given its best step that takes the next row;
    rows may be inserted before."""
    best = list(options)
    for _ in range(3):  # at most three rows in a row: user and assistant behind the system row, and one more
        for state, (_, behind) in enumerate(WANTED):
            best[state] = min(best[state], (best[behind][0] + INSERT, "I", behind))
    return tuple(b[0] for b in best), tuple((b[1], b[2]) for b in best)


#: Behind the last row: the conversation may end without rows or behind an assistant row.
END = with_inserts([(0, "", START), (_NEVER, "", SYSTEM), (_NEVER, "", USER), (0, "", ASSISTANT)])


@functools.cache
def solve(symbol: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """A node from its symbol and the costs to go of the node behind it."""
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    options = []
    for state in range(4):
        choices = [(costs[state] + DELETE, "D", state)]
        if symbol != "x":
            if (state, initial) in STEPS:
                choices.append((costs[STEPS[state, initial]] + KEEP + extra, "K", STEPS[state, initial]))
            choices.append((costs[WANTED[state][1]] + REROLE + extra, "R", WANTED[state][1]))
        options.append(min(choices))
    return with_inserts(options)


def node(symbol: str, behind: tuple) -> tuple:
    """Costs are solved above their least, so that equal nodes are met again."""
    low = min(behind[0])
    costs, steps = solve(symbol, tuple(c - low for c in behind[0]))
    return tuple(c + low for c in costs), steps


def best_audit(stack: list[tuple]) -> str:
    """The edits from the first row on; ``stack`` holds the nodes from the end."""
    out, state, at = [], START, len(stack) - 1
    while True:
        edit, state = stack[at][1][state]
        out.append(edit)
        if edit != "I":
            at -= 1
        if not edit:
            return "".join(out)


def solve_sorted(signatures: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(signature, weight, cost, audit) of (signature, weight) that come sorted by reversed signature."""
    stack, before = [END], ""
    for signature, weight in signatures:
        symbols = signature[::-1]
        shared = next((i for i, (a, b) in enumerate(zip(symbols, before)) if a != b), min(len(symbols), len(before)))
        del stack[shared + 1:]
        for symbol in symbols[shared:]:
            stack.append(node(symbol, stack[-1]))
        before = symbols
        yield signature, weight, stack[-1][0][START], best_audit(stack)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of tuples, some megabytes at a time."""
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or size > most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def streamed(work: Callable[[Iterator[tuple]], Iterator[tuple]], fields: dict[str, pa.DataType]):
    """``work`` for a task's rows, whose first column leads the results too."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            rows = (r for batch in chain([first], batches) for a in range(0, batch.num_rows, 256) for r in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns]))
            yield from in_batches(work(rows), pa.schema([first.schema.field(0), *fields.items()]))

    return per_task


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, weight, cost, audit) of distinct (signature, weight)."""
    reverse = F.reverse("signature")
    ordered = signatures.select("signature", "weight").repartitionByRange(reverse).sortWithinPartitions(reverse)
    return ordered.mapInArrow(streamed(solve_sorted, {"weight": pa.int64(), "cost": pa.int64(), "audit": pa.string()}), _SOLVED)


def digest(role: Column, text: Column) -> Column:
    """Stands for role and text, which no other pair shares; also the order of rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def symbols_of(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, gone, initial, fault) from (conv, turn, role, text, gone); rows that are
    gone only name their conversation. Faults are b, d, t or empty."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = rows.select("conv", "turn", digest(F.col("role"), F.col("text")).alias("key"), "gone", F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    # Dealt out by conversation once; the window finds its rows together and only sorts.
    earlier = F.row_number().over(Window.partitionBy("conv", "gone", "key").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("last") == "", "b").when(earlier, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("")
    return narrow.repartition("conv").select("conv", "turn", "key", "gone", "initial", fault.alias("fault"))


def measured(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of every conversation."""
    symbols = symbols_of(rows)
    conv, longest = symbols.schema["conv"].dataType.simpleString(), (1 << 63) - 1

    def measure(items: Iterator[tuple]) -> Iterator[tuple]:
        for name, group in groupby(items, key=lambda r: r[0]):
            faults, illegal, low, high, distinct, before, signature = {"b": 0, "d": 0, "t": 0, "": 0}, 0, None, None, 0, None, bytearray()
            for _, turn, gone, initial, fault in group:
                if gone:
                    continue
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                faults[fault] += 1
                symbol = initial if initial in ("s", "u", "a") else "o"
                signature += ("x" if fault in ("b", "d") else symbol.upper() if fault else symbol).encode()
            gaps = 0 if low is None else high - low + 1 - distinct
            yield name, gaps if gaps <= longest else None, faults["b"], faults["d"], faults["t"], illegal, signature.decode()

    ordered = symbols.sortWithinPartitions("conv", F.col("gone").desc(), F.asc_nulls_first("turn"), "key", F.col("fault") == "d")
    return ordered.select("conv", "turn", "gone", "initial", "fault").mapInArrow(streamed(measure, MEASURES), _MEASURED.format(conv=conv))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the conversations of (conv, audit): the ``role:text`` of the
    repaired rows, joined by line ends."""
    conv = rows.schema["conv"].dataType.simpleString()

    def follow(items: Iterator[tuple]) -> Iterator[tuple]:
        for name, group in groupby(items, key=lambda r: r[0]):
            audit = next(group)[1]
            running, state, first = hashlib.sha256(), START, True
            for edit in audit:
                row = None if edit == "I" else next(group)
                if edit == "D":
                    continue
                if edit == "K":
                    role, state = row[2], STEPS[state, row[2][0]]
                else:
                    role, state = WANTED[state]
                running.update(f"{'' if first else chr(10)}{role}:{row[3] if row else ''}".encode())
                first = False
            yield name, running.hexdigest()

    both = rows.where("NOT gone").select("conv", "turn", digest(F.col("role"), F.col("text")).alias("key"), F.lit(None).cast("string").alias("audit"), "role", "text")
    head = audits.select("conv", F.lit(None).cast(both.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    dealt = both.unionByName(head).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "key")
    return dealt.select("conv", "audit", "role", "text").mapInArrow(streamed(follow, {"repaired_sha256": pa.string()}), _REPAIRED.format(conv=conv))


def repair(rows: DataFrame) -> DataFrame:
    """Measures, cost, audit and digest of the repaired rows of every conversation of (conv, turn,
    role, text, gone); a row that is gone only names its conversation."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    found = staged(measured(rows), "conversations-measured")
    distinct = staged(found.groupBy("signature").agg(F.count("*").alias("weight")), "signatures")
    audits = staged(solved(distinct), "signature-audits")
    known = staged(looked_up(found, audits, "signature", "weight"), "conversations-audits")
    digests = repaired(rows, known.select("conv", "audit"))
    return known.drop("signature", "weight").join(digests.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
