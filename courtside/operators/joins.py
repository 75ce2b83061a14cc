"""Joins on shared names, group statistics joined back, group maxima.

No side is hinted for broadcast. Spark broadcasts a side whose size it knows to be
under ``spark.sql.autoBroadcastJoinThreshold``: file sizes at planning, measured
shuffle sizes at run time. Everything larger is a sort-merge join, where adaptive
execution splits a hot key's partition. That holds for all joins here, because
each one has a plain or null-safe equality on its keys.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions import largest

log = logging.getLogger(__name__)


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Column names both tables have, in the left table's order."""
    shared = set(right.columns)
    keys = [c for c in left.columns if c in shared]
    if not keys:
        raise ValueError("the tables share no column name")
    log.info("joining by %s", keys)
    return keys


def join_natural(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    on: Sequence[str] | None = None,
    null_keys: str = "match",
    suffix: str = "_r",
    unique_right: bool = False,
) -> DataFrame:
    """Join by ``on``, or by all shared names, keeping each key once.

    ``null_keys="match"`` pairs null with null; ``"never"`` is the SQL rule and keeps
    an existing partitioning or bucketing by the keys usable. Other names the tables
    share get ``suffix`` on the right. In a right join the keys are the right table's.
    ``unique_right`` makes the query fail where a key repeats on the right, instead of multiplying rows.
    """
    if how not in ("left", "right", "inner"):
        raise ValueError(f"how must be 'left', 'right' or 'inner', not {how!r}")
    if null_keys not in ("match", "never"):
        raise ValueError(f"null_keys must be 'match' or 'never', not {null_keys!r}")
    keys = list(on) if on else natural_keys(left, right)
    if unique_right:
        right = assert_unique(right, keys)
    taken = set(left.columns) - set(keys)
    right = right.select(*keys, *[c for c in right.columns if c not in keys])
    # Renaming only what needs it: an alias that changes nothing can keep Spark from seeing
    # that two uses of a table are the same.
    right = right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in taken})
    if null_keys == "never":
        return left.join(right, keys, how).select(
            *[c for c in left.columns], *[c for c in right.columns if c not in keys]
        )

    def other(key: str) -> str:
        return f"__right_{key}"

    renamed = right.withColumnsRenamed({k: other(k) for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(other(k))) for k in keys])
    from_right = set(keys) if how == "right" else set()
    return left.join(renamed, same, how).select(
        *[F.col(other(c)).alias(c) if c in from_right else F.col(c) for c in left.columns],
        *[c for c in right.columns if c not in keys],
    )


def with_group_stats(df: DataFrame, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Add group aggregates to each row.

    An aggregate joined back rather than a window: partial sums shrink a hot group
    before the shuffle, and no task has to hold a whole group. Reads ``df`` twice, once for
    the columns of the aggregates only.
    """
    grouped = df.groupBy(*by).agg(*[c.alias(name) for name, c in stats.items()])
    return join_natural(df, grouped, on=by, null_keys="match")


def keep_group_max(df: DataFrame, by: Sequence[str], column: str, nulls: str = "skip", ties: str = "few") -> DataFrame:
    """Rows where ``column`` is the maximum of its group; ties all stay.

    One scan and one shuffle: rows are ranked within their group, and Spark applies the limit to the first rank before the
    shuffle already, so a task sends only the rows that are a maximum among its own. ``ties="many"`` is for groups nearly all
    of whose rows share the maximum, where that limit leaves everything: the maxima are aggregated and joined on the group
    *and* the value, a join that adaptive execution can split, at the price of a second scan of ``by`` and ``column``.

    ``nulls="skip"`` passes missing values over; ``"propagate"`` drops a group that has one, since its maximum is unknown.
    """
    if nulls not in ("skip", "propagate"):
        raise ValueError(f"nulls must be 'skip' or 'propagate', not {nulls!r}")
    if ties not in ("few", "many"):
        raise ValueError(f"ties must be 'few' or 'many', not {ties!r}")
    value = F.col(column)
    if ties == "many":
        top = df.groupBy(*by).agg(largest(column, nulls).alias(column))
        top = top.filter(value.isNotNull()).toDF(*[f"__top_{c}" for c in (*by, column)])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__top_{k}")) for k in by], value == F.col(f"__top_{column}"))
        return df.join(top, same, "left_semi")
    if nulls == "skip":
        order, known = value.desc(), df.filter(value.isNotNull())
    else:
        # a missing value comes first, so it keeps the group's other rows from rank 1 and goes itself afterwards
        order, known = value.desc_nulls_first(), df
    ranked = known.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(order)))
    return ranked.filter((F.col("__rank") == 1) & value.isNotNull()).drop("__rank")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, one row per key; the query that uses it fails where a key repeats.

    The check is part of that query, not a job of its own: rows are grouped by the key, which a join on it needs
    anyway, and a group of two raises. Null is a key like any other.
    """
    others = [c for c in df.columns if c not in keys]
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    repeated = F.raise_error(F.concat(F.lit("key is not unique: "), told)).cast("boolean")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others])
    return grouped.filter(F.when(F.col("__n") > 1, repeated).otherwise(True)).select(*df.columns)
