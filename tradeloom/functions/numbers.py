"""Numeric cleaning and rounding as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters removed from numeric cells, and cell texts that mean "no value".
CURRENCY_AND_GROUPING = r"[£$€¥₹,\s]"
NO_VALUE = ["nan", "None", "", "-", "N/A", "n/a"]
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MARKS = "£$€¥₹, \t\n\x0b\f\r"
WHOLE_NUMBER = r"\A([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)%?\z"


def parse_number(text: Column) -> Column:
    """Double, or NULL when the text is not a plain decimal number. ``1e400`` reads as infinity.

    The pattern guard is needed because a bare cast also accepts ``12d`` and ``nan``.
    """
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def without_marks(text: Column) -> Column:
    """Cell without currency, grouping and percent signs."""
    return F.regexp_replace(F.regexp_replace(text, CURRENCY_AND_GROUPING, ""), "%$", "")


def in_range(number: Column, kind: str) -> Column:
    """The number as the given type, NULL when it is not finite or too large for it."""
    return F.when(F.abs(number) < float("inf"), number.try_cast(kind))


def cell_number(text: Column, kind: str = "double") -> Column:
    """Number held in a free-form cell, NULL when it is unreadable, not finite or too large for the
    type. The cell stands once in the expression, so that many such columns compile together;
    the texts that mean "no value" are no plain numbers either. ``MARKS`` are the characters of
    ``CURRENCY_AND_GROUPING``, dropped without a pattern."""
    plain = F.regexp_extract(F.translate(text, MARKS, ""), WHOLE_NUMBER, 1)
    if kind.startswith("decimal"):
        return plain.try_cast("double").try_cast(kind)
    # Infinity is the one double that no decimal text within the range stands for.
    return F.nullif(F.nullif(plain.try_cast(kind), F.lit(float("inf"))), F.lit(float("-inf")))


def clean_numeric(text: Column) -> Column:
    """Number held in a free-form cell; anything unreadable or not finite counts as 0."""
    return F.coalesce(cell_number(text), F.lit(0.0))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """Value as double with NULL and NaN replaced."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(float(default))).otherwise(number)


def or_default(value: Column, default) -> Column:
    """``value`` unless it is missing or zero."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(value.isNull() | (value == 0), default).otherwise(value)


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, NULL when the whole is 0 or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def whole(value: Column) -> Column:
    """Nearest integer, ties to even, as BIGINT."""
    return F.bround(value, 0).cast("bigint")


def exact_mean(value: Column) -> Column:
    """Mean that does not depend on the order rows arrive in: the sum is kept in decimal, and
    the result is rounded far below any threshold so that thirds add up."""
    return F.round(F.try_divide(F.sum(value.try_cast("decimal(38,12)")).cast("double"), F.count(value).cast("double")), 9)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
