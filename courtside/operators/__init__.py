"""General table verbs: DataFrame in, lazily evaluated DataFrame out."""

from courtside.operators.columns import (
    across,
    clean_names,
    column_range,
    positions,
    relocate_first,
    separate,
)
from courtside.operators.joins import (
    assert_unique,
    join_natural,
    keep_group_max,
    natural_keys,
    with_group_stats,
)
from courtside.operators.models import add_fit, ols
from courtside.operators.ordering import arrange, top
from courtside.operators.reshape import (
    pivot_nested,
    pivot_wider,
    two_sides,
    union_by_name,
    unnest,
    unnest_vector,
)
from courtside.operators.reuse import reuse_point, shared_folder, stage
from courtside.operators.shares import add_totals, running_share, share_of_total, totals_by

__all__ = [
    "across",
    "add_fit",
    "add_totals",
    "arrange",
    "assert_unique",
    "clean_names",
    "column_range",
    "join_natural",
    "keep_group_max",
    "natural_keys",
    "ols",
    "pivot_nested",
    "pivot_wider",
    "positions",
    "relocate_first",
    "reuse_point",
    "running_share",
    "separate",
    "share_of_total",
    "shared_folder",
    "stage",
    "top",
    "totals_by",
    "two_sides",
    "union_by_name",
    "unnest",
    "unnest_vector",
    "with_group_stats",
]
