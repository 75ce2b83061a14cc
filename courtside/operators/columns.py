"""Verbs over column lists. They only build projections; no data moves."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Letters that have no base letter and mark in Unicode, and how they are written without.
PLAIN_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i"}


def _plain(name: str) -> str:
    """Letters without their marks: ``Équipe`` -> ``Equipe``."""
    parts = unicodedata.normalize("NFKD", "".join(PLAIN_LETTERS.get(c, c) for c in name))
    return "".join(c for c in parts if not unicodedata.combining(c))


def snake(name: str) -> str:
    """One column name in snake case: ``PSxG`` -> ``p_sx_g``, ``Tee Direction`` -> ``tee_direction``, ``Équipe`` -> ``equipe``."""
    name = _plain(name).replace("%", "_percent_").replace("#", "_number_").replace("'", "")
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return f"x{name}" if not name or name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeats get the first free of ``_2``, ``_3``, ..."""
    names: list[str] = []
    for name in map(snake, df.columns):
        free, nth = name, 1
        while free in names:
            nth += 1
            free = f"{name}_{nth}"
        names.append(free)
    return df.toDF(*names)


def positions(df: DataFrame, first: int, last: int) -> list[str]:
    """Names of columns ``first`` to ``last``, counted from 1, both included."""
    if not 1 <= first <= last <= len(df.columns):
        raise ValueError(f"no columns {first}:{last} among {len(df.columns)}")
    return df.columns[first - 1 : last]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    start, stop = df.columns.index(first), df.columns.index(last)
    if start > stop:
        raise ValueError(f"{first!r} comes after {last!r}")
    return df.columns[start : stop + 1]


def relocate_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Put ``names`` first and keep the rest in order."""
    return df.select(*names, *[c for c in df.columns if c not in set(names)])


def across(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """Apply ``fn`` to each named column, in place or as copies with ``suffix``."""
    return df.withColumns({f"{c}{suffix}": fn(F.col(c)) for c in names})


def _piece(text: Column, delimiter: str, i: int) -> Column:
    if i == 0:
        return F.substring_index(text, delimiter, 1)
    # The text up to the i-th delimiter is the whole text when there are fewer.
    present = F.substring_index(text, delimiter, i) != text
    return F.when(present, F.split_part(text, F.lit(delimiter), F.lit(i + 1)))


def separate(df: DataFrame, column: str, into: Sequence[str], pattern: str, literal: bool = False) -> DataFrame:
    """Split a text column into the columns ``into``, in its place.

    ``pattern`` is a regular expression, or with ``literal=True`` a plain delimiter, which
    is much cheaper per row. Missing pieces are null and surplus pieces are dropped.
    """
    text = F.col(column)
    if literal:
        found = [_piece(text, pattern, i) for i in range(len(into))]
    else:
        parts = F.split(text, pattern)
        found = [F.get(parts, F.lit(i)) for i in range(len(into))]
    out: list[Column] = []
    for c in df.columns:
        out.extend([p.alias(name) for p, name in zip(found, into)] if c == column else [F.col(c)])
    return df.select(*out)
