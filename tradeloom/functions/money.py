"""Money and percentage texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grouped(value: Column) -> Column:
    """Integer text with thousands separators, ties to even."""
    return F.format_string("%,d", F.bround(F.coalesce(value.cast("double"), F.lit(0.0)), 0).cast("bigint"))


def pounds(value: Column) -> Column:
    """``£1,234``; the sign follows the currency mark as in ``£-5``."""
    return F.concat(F.lit("£"), grouped(value))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text with the given number of decimals."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


def signed(value: Column, digits: int) -> Column:
    """Fixed-point text with an explicit plus sign on values from zero up."""
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), fixed(value, digits))


def gbp_compact(value: Column) -> Column:
    """``£1.2m``, ``£34k`` or ``£567``."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return (
        F.when(F.abs(v) >= 1e6, F.concat(F.lit("£"), fixed(v / 1e6, 1), F.lit("m")))
        .when(F.abs(v) >= 1e3, F.concat(F.lit("£"), fixed(v / 1e3, 0), F.lit("k")))
        .otherwise(pounds(v))
    )
