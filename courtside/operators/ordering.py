"""Sorting with nulls last in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrange(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by ``keys``; a leading ``-`` means falling. Nulls come last either way.

    Give a unique key last: it settles ties, and lets the range partitions of the sort
    split a value that many rows share.
    """
    order = [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]
    return df.orderBy(*order)


def top(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First ``n`` rows by ``keys``; each task keeps ``n`` rows, nothing is fully sorted."""
    return arrange(df, *keys).limit(n)
