"""Course handicaps from rounds and hole-by-hole cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import as_column, half_even, rows, total

# Fixed value: slope of a course of standard difficulty.
BASE_SLOPE = 113


def adjusted_par(
    handicap_index: Column | str,
    slope: Column | str,
    rating: Column | str,
    pc_coeff: Column | str,
    base_slope: float = BASE_SLOPE,
) -> Column:
    """Strokes the index, the course and the day's conditions give, halves rounded to even."""
    return half_even(as_column(handicap_index) * as_column(slope) / F.lit(base_slope) + as_column(rating)) + as_column(pc_coeff)


def course_handicap(
    rounds: DataFrame, holes: DataFrame, base_slope: float = BASE_SLOPE, nulls: str = "propagate", how: str = "left"
) -> DataFrame:
    """Per round: holes on its card, par, adjusted par and course handicap.

    A hole without par leaves the round without par and handicap (``nulls="skip"`` sums the others). A round without card
    stays, without holes, par and handicap; ``how="inner"`` leaves it out.

    Pars are summed per round before the join, so holes cross the network as one row per round and task.
    """
    cards = holes.groupBy("round_id").agg(total("par", nulls).alias("par"), rows().alias("holes"))
    played = rounds.join(cards, ["round_id"], how).withColumn(
        "adjusted_par", adjusted_par("handicap_index", "slope", "rating", "pc_coeff", base_slope).cast("int")
    )
    return played.withColumn("course_handicap", F.col("adjusted_par") - F.col("par"))
