"""Shot classes and finishing outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.numeric import as_column

# xG cut-offs, best class first. The table of shots and the table of
# xG values use different top cut-offs.
SHOT_CUTS = (0.16, 0.08, 0.03)
DISTRIBUTION_CUTS = (0.15, 0.08, 0.03)

# Class labels, best first.
PENALTY = "Penalty"
CHANCES = ("Above-Average Chance", "Average Chance", "Below-Average Chance")
POOR = "Poor Chance"

# What ``outcome`` says for a shot on target.
GOAL = "Goal"
SAVED = "Saved"
ON_TARGET = "On-Target"
OFF_TARGET = "Off-Target"

TIES = ("added", "separate", "subtracted")


def shot_class(xg: Column | str, cuts: Sequence[float] = SHOT_CUTS, penalty: Column | None = None) -> Column:
    """Label a chance by its xG; a null xG is a poor chance unless it is a penalty."""
    if len(cuts) != len(CHANCES) or list(cuts) != sorted(cuts, reverse=True):
        raise ValueError(f"cuts must be {len(CHANCES)} falling numbers, not {cuts!r}")
    xg = as_column(xg)
    bands = [(xg >= F.lit(cut), name) for cut, name in zip(cuts, CHANCES)]
    if penalty is not None:
        bands.insert(0, (penalty == 1, PENALTY))
    label = F
    for condition, name in bands:
        label = label.when(condition, F.lit(name))
    return label.otherwise(F.lit(POOR))


def finishing(tie: str, xg: Column | str = "xg", psxg: Column | str = "psxg") -> dict[str, Column]:
    """Boolean columns for what the finish did to the chance.

    ``tie`` says where a shot with ``psxg == xg`` goes: with the ``"added"`` shots,
    with the ``"subtracted"`` ones, or in a class of its own (``"separate"``).
    """
    if tie not in TIES:
        raise ValueError(f"tie must be one of {TIES}, not {tie!r}")
    xg, psxg = as_column(xg), as_column(psxg)
    on_frame = psxg != 0
    flags = {
        "miss_target": psxg == 0,
        "subtr_value": on_frame & ((psxg <= xg) if tie == "subtracted" else (psxg < xg)),
    }
    if tie == "separate":
        flags["equal_value"] = on_frame & (psxg == xg)
    flags["added_value"] = on_frame & ((psxg >= xg) if tie == "added" else (psxg > xg))
    return flags


def scored(outcome: Column | str = "outcome") -> Column:
    return as_column(outcome) == GOAL
