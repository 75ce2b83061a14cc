"""Shares of a total, running shares and totals rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import per
from courtside.operators.joins import join_natural
from courtside.operators.reuse import reuse_point

# Labels of an appended totals row.
TOTAL = "Total"
FILLER = "-"

# Steps of the running share at most, a power of two: their sums meet in one task.
SHARE_STEPS = 1024
# Rank error of the quantiles between steps: one in so many rows.
SHARE_ACCURACY = 50_000


def share_of_total(df: DataFrame, weight: str, name: str) -> DataFrame:
    """Add ``weight`` over its sum across all rows.

    The sum is a one-value subquery, so the rows stay where they are; a window without
    a partition would move all of them into one task.
    """
    rows = reuse_point(df)
    grand = rows.agg(F.sum(weight)).scalar()
    return rows.withColumn(name, per(weight, grand))


def add_quantile_step(rows: DataFrame, order: str, name: str, steps: int = SHARE_STEPS) -> DataFrame:
    """Add the number of the step that ``order`` is in, from 0; null is in a step of its own after all others.

    The limits between steps are quantiles of the column, from a sketch that partial aggregates merge, so steps hold about
    as many rows whatever the values. Finding a value's step is a bisection over the limits.
    """
    if steps < 2 or steps & (steps - 1):
        raise ValueError(f"steps must be a power of two, not {steps}")
    shares = [k / steps for k in range(1, steps)]
    limited = rows.withColumn("__limits", rows.agg(F.percentile_approx(order, shares, SHARE_ACCURACY)).scalar())
    halves = F.array(*[F.lit(steps >> k) for k in range(1, steps.bit_length())])
    # the number of limits below the value: a half of those left is passed if its last limit is below
    limit = lambda k: F.get(F.col("__limits"), k - 1)
    below = F.aggregate(halves, F.lit(0), lambda at, half: F.when(limit(at + half) < F.col(order), at + half).otherwise(at))
    return limited.withColumn(name, F.when(F.col(order).isNull(), F.lit(steps)).otherwise(below)).drop("__limits")


def running_share(
    df: DataFrame, order: str, weight: str, name: str, step: Callable[[Column], Column] | None = None, steps: int = SHARE_STEPS
) -> DataFrame:
    """Add the running sum of ``weight`` by rising ``order`` over its total; null order comes last.

    In two levels, since one window over all rows would put them into one task: each step's sum is accumulated over the
    steps and the rows are accumulated within theirs. Steps lie between quantiles of ``order`` (:func:`add_quantile_step`), or
    ``step`` maps it to equally ordered steps, never null. ``order`` is a number, a date or a time that does not repeat.
    """
    rows = reuse_point(df)
    rows = add_quantile_step(rows, order, "__step", steps) if step is None else rows.withColumn("__step", step(F.col(order)))
    summed = rows.groupBy("__step").agg(F.sum(weight).alias("__sum"))
    everything = Window.orderBy(F.col("__step").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_steps = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = summed.select(
        "__step",
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
        F.sum("__sum").over(all_steps).alias("__grand"),
    )
    within = Window.partitionBy("__step").orderBy(F.col(order).asc_nulls_last())
    so_far = F.col("__before") + F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        join_natural(rows, summed, on=["__step"], null_keys="never")
        .withColumn(name, per(so_far, "__grand"))
        .drop("__step", "__before", "__grand")
    )


def add_totals(
    df: DataFrame,
    ratios: Mapping[str, Column] | None = None,
    mode: str = "recompute",
    label: str = TOTAL,
    filler: str = FILLER,
) -> DataFrame:
    """Append a row with the sums of the numeric columns.

    The first column becomes text and holds ``label`` in that row; other text columns
    hold ``filler`` and the rest null. ``ratios`` gives the expressions of columns that
    are not additive: they are computed from the summed columns, or with
    ``mode="sum_all"`` summed like the others. When ``df`` is an aggregate, the
    rows and their sums share its shuffle.
    """
    if mode not in ("recompute", "sum_all"):
        raise ValueError(f"mode must be 'recompute' or 'sum_all', not {mode!r}")
    ratios = dict(ratios or {}) if mode == "recompute" else {}
    df = reuse_point(df)
    first, *others = df.columns
    sums, labels = [], {first: F.lit(label)}
    for c in others:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType):
            if c not in ratios:
                sums.append(F.sum(c).alias(c))
        else:
            labels[c] = F.lit(filler) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
    body = df.withColumn(first, F.col(first).cast("string"))
    bottom = df.agg(*sums).withColumns(labels)
    for name, expression in ratios.items():
        bottom = bottom.withColumn(name, expression)
    return body.unionByName(bottom.select(*df.columns))


def totals_by(
    df: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, Column],
    ratios: Mapping[str, Column] | None = None,
    label: str = TOTAL,
    filler: str = FILLER,
) -> DataFrame:
    """Group by ``by`` and append a row of totals, both from one aggregate with grouping sets.

    ``measures`` are aggregates, ``ratios`` expressions of them that hold in the total row too. Every input row counts
    towards its group and the total before the shuffle, so there is one scan and one shuffle, and the total can be any
    aggregate (a mean or a distinct count), not only a sum of the groups. Keys become text; the first holds ``label`` and
    the others ``filler`` in the total row. An empty table gives no rows.
    """
    sets = df.groupingSets([list(by), []], *by).agg(F.grouping_id().alias("__level"), *[c.alias(name) for name, c in measures.items()])
    total = F.col("__level") > 0
    keys = [F.when(total, F.lit(label if k == 0 else filler)).otherwise(F.col(c).cast("string")).alias(c) for k, c in enumerate(by)]
    rows = sets.select(*keys, *measures)
    for name, expression in (ratios or {}).items():
        rows = rows.withColumn(name, expression)
    return rows
