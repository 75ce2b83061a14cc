"""Aggregates with the null rule spelled out.

``nulls="skip"`` is Spark's rule. ``nulls="propagate"`` makes a group's result null
as soon as one input is null. Both are partial aggregates, so rows are combined
before the shuffle and a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.numeric import as_column


def _with_rule(result: Column, x: Column, nulls: str) -> Column:
    if nulls == "skip":
        return result
    if nulls == "propagate":
        return F.when(F.count_if(x.isNull()) == 0, result)
    raise ValueError(f"nulls must be 'skip' or 'propagate', not {nulls!r}")


def total(x: Column | str, nulls: str = "skip") -> Column:
    return _with_rule(F.sum(as_column(x)), as_column(x), nulls)


def mean(x: Column | str, nulls: str = "skip") -> Column:
    return _with_rule(F.avg(as_column(x)), as_column(x), nulls)


def sd(x: Column | str, nulls: str = "skip") -> Column:
    """Sample standard deviation; null for a single row."""
    return _with_rule(F.stddev_samp(as_column(x)), as_column(x), nulls)


def smallest(x: Column | str, nulls: str = "skip") -> Column:
    return _with_rule(F.min(as_column(x)), as_column(x), nulls)


def largest(x: Column | str, nulls: str = "skip") -> Column:
    return _with_rule(F.max(as_column(x)), as_column(x), nulls)


def count_true(condition: Column, nulls: str = "skip") -> Column:
    return _with_rule(F.count_if(condition), condition, nulls)


def rows() -> Column:
    return F.count(F.lit(1))


def nested_total(column: str, field: str, nulls: str = "skip") -> Column:
    """Sum of one field over a row's own array of structs, under the same null rule as :func:`total`."""
    values = F.col(f"{column}.{field}")
    known = F.filter(values, lambda v: v.isNotNull())
    summed = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    if nulls == "skip":
        return F.when(F.size(known) > 0, summed)
    if nulls == "propagate":
        return F.when(F.size(known) == F.size(values), summed)
    raise ValueError(f"nulls must be 'skip' or 'propagate', not {nulls!r}")
