"""Registered queries and the DuckDB SQL each is checked against.

The SQL shares building blocks (``CTES``) that restate the fixtures and the analysis
tables independently of the Spark code; ``with_tables`` puts the needed ones in front.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_tables(sql)
        return fn
    return keep


def needed(sql: str) -> list[str]:
    """Building blocks a text mentions, dependencies first."""
    found: list[str] = []
    for name in CTES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            for dep in [*needed(CTES[name]), name]:
                if dep not in found:
                    found.append(dep)
    return found


def with_tables(sql: str) -> str:
    names = needed(sql)
    if not names:
        return sql
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in sorted(names, key=list(CTES).index))
    return f"WITH {blocks}\n{sql}"


# Small SQL text helpers.

def mean(x: str) -> str:
    return f"round(cast(sum(cast({x} as decimal(24,12))) as double) / count({x}), 9)"


def whole(x: str) -> str:
    return f"cast(round_even({x}, 0) as bigint)"


def grouped(x: str) -> str:
    return "format('{:,}', " + whole(f"coalesce(cast({x} as double), 0)") + ")"


def pounds(x: str) -> str:
    return f"('£' || {grouped(x)})"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even(cast({x} as double), {digits}))"


def signed(x: str, digits: int) -> str:
    return f"(case when {x} >= 0 then '+' else '' end || {fixed(x, digits)})"


def compact(x: str) -> str:
    return (f"(case when abs({x}) >= 1e6 then '£' || {fixed(f'({x})/1e6', 1)} || 'm' "
            f"when abs({x}) >= 1e3 then '£' || {fixed(f'({x})/1e3', 0)} || 'k' else {pounds(x)} end)")


def text(template: str, **fields: str) -> str:
    """Template with ``{field}`` marks as a SQL concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [f"cast({fields[p]} as varchar)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces) if p]
    return "(" + " || ".join(parts) + ")"
