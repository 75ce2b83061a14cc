"""Nested to long, long to wide, and wide rows seen from two sides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row per struct of an array column, its fields as columns; empty arrays give no row."""
    return df.select(*[c for c in df.columns if c != column], F.inline(column))


def unnest_vector(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column, in place; empty arrays give no row."""
    return df.select(*[F.explode(c).alias(c) if c == column else F.col(c) for c in df.columns])


def _filled(absent: Column, cell: Column, fill: float | None) -> Column:
    # Only an absent cell is filled; a cell that holds null stays null.
    return cell if fill is None else F.when(absent, F.lit(fill)).otherwise(cell)


def _clash(name: str) -> Column:
    return F.raise_error(F.lit(f"more than one value for {name!r} in a cell; pass duplicates='sum'"))


def pivot_wider(
    df: DataFrame,
    names_from: str,
    values_from: str,
    names: Sequence[str],
    fill: float | None = None,
    duplicates: str = "error",
) -> DataFrame:
    """Long to wide; all other columns are the row's identity.

    ``names`` fixes the new columns, so no job looks for them and the schema does not
    depend on the data. One grouped aggregation, hence one shuffle. A cell with two
    values fails the query, or is summed on request.
    """
    if duplicates not in ("error", "sum"):
        raise ValueError(f"duplicates must be 'error' or 'sum', not {duplicates!r}")
    ids = [c for c in df.columns if c not in (names_from, values_from)]
    kind = df.schema[values_from].dataType
    cells = []
    for name in names:
        here = F.col(names_from) == name
        value = F.when(here, F.col(values_from))
        count = F.count_if(here)
        if duplicates == "sum":
            cell = F.sum(value)
        else:
            cell = F.when(count > 1, _clash(name).cast(kind)).otherwise(F.max(value))
        cells.append(_filled(count == 0, cell, fill).alias(name))
    return df.groupBy(*ids).agg(*cells)


def pivot_nested(
    df: DataFrame,
    column: str,
    names_from: str,
    values_from: str,
    names: Sequence[str],
    fill: float | None = None,
    duplicates: str = "error",
) -> DataFrame:
    """:func:`unnest` followed by :func:`pivot_wider`, inside each row and so without a shuffle.

    Equal to the two steps when each row has its own identity, as it has when a row is the
    parent of its array. Rows with an empty array go, as in :func:`unnest`. One of the ``names``
    twice in an array fails the query, or is summed on request; other names do not matter.
    """
    if duplicates not in ("error", "sum"):
        raise ValueError(f"duplicates must be 'error' or 'sum', not {duplicates!r}")
    # Fields are taken out of the array one by one, so that the scan reads these two alone.
    labels, values = F.col(f"{column}.{names_from}"), F.col(f"{column}.{values_from}")
    pairs = F.arrays_zip(labels.alias("label"), values.alias("value"))
    kind = df.select(F.element_at(values, 1).alias("v")).schema["v"].dataType

    def cell(name: str) -> Column:
        hits = F.transform(F.filter(pairs, lambda pair: pair["label"] == name), lambda pair: pair["value"])
        if duplicates == "sum":
            known = F.filter(hits, lambda v: v.isNotNull())
            value = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(kind), lambda total, v: (total + v).cast(kind)))
        else:
            value = F.when(F.size(hits) > 1, _clash(name).cast(kind)).otherwise(F.get(hits, F.lit(0)))
        return _filled(F.size(hits) == 0, value, fill)

    ids = [c for c in df.columns if c != column]
    return df.filter(F.size(labels) > 0).select(*ids, *[cell(name).alias(name) for name in names])


def two_sides(df: DataFrame, sides: Sequence[dict[str, Column]]) -> DataFrame:
    """One output row per side of each input row; each side maps names to expressions.

    A single pass, where a union of one projection per side would read the input once per side.
    """
    rows = [F.struct(*[c.alias(name) for name, c in side.items()]) for side in sides]
    return df.select(F.inline(F.array(*rows)))


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Append tables by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
