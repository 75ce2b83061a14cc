"""Column -> Column building blocks; all built-in expressions, no Python UDF."""

from courtside.functions.aggregates import count_true, largest, mean, nested_total, rows, sd, smallest, total
from courtside.functions.distributions import student_t_quantile
from courtside.functions.numeric import (
    as_column,
    half_even,
    half_even_2,
    if_else,
    in_thousands,
    nineties,
    num,
    per,
    per96,
    sum_of,
    whole,
)
from courtside.functions.shooting import DISTRIBUTION_CUTS, SHOT_CUTS, finishing, scored, shot_class
from courtside.functions.text import clock_time, decimals, label, matches, number_text

__all__ = [
    "DISTRIBUTION_CUTS",
    "SHOT_CUTS",
    "as_column",
    "clock_time",
    "count_true",
    "decimals",
    "finishing",
    "half_even",
    "half_even_2",
    "if_else",
    "in_thousands",
    "label",
    "largest",
    "matches",
    "mean",
    "nested_total",
    "nineties",
    "num",
    "number_text",
    "per",
    "per96",
    "rows",
    "scored",
    "sd",
    "shot_class",
    "smallest",
    "student_t_quantile",
    "sum_of",
    "total",
    "whole",
]
