"""Column -> Column helpers for numbers.

The table scripts this library serves divide by zero and parse blank text freely;
under ANSI mode a plain cast or ``/`` would fail the job, so both go through the
``try_`` forms and give null instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MATCH_MINUTES = 96
NINETY = 90
THOUSAND = 1000


def as_column(x: Column | str) -> Column:
    """A column from its name, or as it is."""
    return F.col(x) if isinstance(x, str) else x


def sum_of(names: Sequence[str]) -> Column:
    """Plain sum of columns, in order: null if one is missing."""
    return reduce(Column.__add__, [F.col(c) for c in names])


# Text that is a number: sign, digits with or without a point, exponent.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num(x: Column | str) -> Column:
    """Text to double; blank or unparsable text is null, and so is what only Java reads as a number (``1d``, ``NaN``)."""
    text = as_column(x).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def whole(x: Column | str) -> Column:
    """Text to int; blank or unparsable text is null."""
    return as_column(x).try_cast("int")


def per(x: Column | str, y: Column | str) -> Column:
    """``x / y`` as a double, null where ``y`` is zero."""
    return F.try_divide(as_column(x), as_column(y))


def per96(x: Column | str, minutes: Column | str) -> Column:
    """Rate per 96 minutes played."""
    return per(F.lit(MATCH_MINUTES) * as_column(x), minutes)


def nineties(minutes: Column | str) -> Column:
    return as_column(minutes) / F.lit(NINETY)


def in_thousands(x: Column | str) -> Column:
    return as_column(x) / F.lit(THOUSAND)


def half_even(x: Column | str) -> Column:
    """Round to a whole number, halves to the even neighbour (2.5 -> 2)."""
    return F.rint(as_column(x))


def half_even_2(x: Column | str) -> Column:
    """Round to two decimals through :func:`half_even`."""
    return half_even(as_column(x) * F.lit(100)) / F.lit(100)


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays null where the condition is null.

    ``F.when`` alone would take the ``no`` branch there.
    """
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)
