"""Shot quality: what the finish did to each chance, by class, player and team."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions import (
    DISTRIBUTION_CUTS,
    SHOT_CUTS,
    count_true,
    decimals,
    finishing,
    half_even_2,
    if_else,
    label,
    largest,
    matches,
    num,
    per,
    rows,
    scored,
    shot_class,
    smallest,
    total,
)
from courtside.functions.shooting import GOAL, OFF_TARGET, ON_TARGET, SAVED
from courtside.operators import (
    across,
    add_fit,
    arrange,
    clean_names,
    column_range,
    join_natural,
    ols,
    positions,
    relocate_first,
    reuse_point,
    running_share,
    separate,
    share_of_total,
)

PLAYER_KEYS = ["player", "squad", "country", "season_end_year"]
SEASON_KEYS = ["country", "season_end_year"]

# Least shots for the table of players and for the points of the model.
MIN_SHOTS_TABLE = 25
MIN_SHOTS_POINTS = 15

# Names of the axes in the model's label.
Y_LABEL = "[goals above expected]"
X_LABEL = "[good shots above expected]"


def clean_shots(shots: DataFrame, cuts: Sequence[float] = SHOT_CUTS, lead: tuple[int, int] = (2, 7)) -> DataFrame:
    """Shots as delivered to typed, classified shots.

    ``"Name (pen)"`` becomes player and penalty 0/1, xG and post-shot xG become numbers
    (post-shot: missing is 0), ``on_target`` says whether post-shot xG was there at all.
    ``lead`` are the positions of the columns that go first (date to player).
    """
    named = separate(clean_names(shots), "player", ("player", "penalty"), " (", literal=True)
    typed = named.withColumns(
        {
            "xg": num("x_g"),
            "psxg": F.coalesce(num("p_sx_g"), F.lit(0.0)),
            "on_target": F.when(num("p_sx_g").isNull(), OFF_TARGET).otherwise(ON_TARGET),
            "penalty": F.when(F.col("penalty").isNull(), 0).otherwise(1),
        }
    )
    classed = typed.withColumn("shot_class", shot_class("xg", cuts, F.col("penalty")))
    return classed.select(
        *positions(named, *lead),
        "penalty",
        "xg",
        "psxg",
        "outcome",
        "shot_class",
        "distance",
        "body_part",
        "on_target",
        "country",
        "season_end_year",
        "match_url",
    )


def shot_class_summary(clean: DataFrame, tie: str = "added", nulls: str = "skip") -> DataFrame:
    """Per shot class: shots, share of all shots, xG range, share of each outcome; best class first."""
    flags = finishing(tie)
    counted = clean.groupBy("shot_class").agg(
        rows().alias("n"),
        smallest("xg", nulls).alias("xg_min"),
        largest("xg", nulls).alias("xg_max"),
        *[count_true(c, nulls).alias(name) for name, c in flags.items()],
    )
    shares = share_of_total(across(counted, flags, lambda c: per(c, "n")), "n", "pct")
    return arrange(relocate_first(shares, ["shot_class", "n", "pct"]), "-xg_min", "shot_class")


def xg_distribution(
    clean: DataFrame, cuts: Sequence[float] = DISTRIBUTION_CUTS, tie: str = "separate", nulls: str = "skip"
) -> DataFrame:
    """Per xG value: shots, share of each outcome, goals, cumulative share of shots, class; rising xG."""
    flags = finishing(tie)
    counted = clean.groupBy("xg").agg(
        rows().alias("n"),
        *[count_true(c, nulls).alias(name) for name, c in flags.items()],
        count_true(scored(), nulls).alias("goal"),
    )
    shares = running_share(across(counted, flags, lambda c: per(c, "n")), "xg", "n", "cdf")
    return arrange(shares.withColumn("shot_class", shot_class("xg", cuts)), "xg")


def on_target_by_outcome(clean: DataFrame) -> DataFrame:
    """Shots on and off target, where on target means the outcome was a goal or a save."""
    hit = (F.col("outcome") == GOAL) | (F.col("outcome") == SAVED)
    return (
        clean.withColumn("on_target", if_else(hit, F.lit(ON_TARGET), F.lit(OFF_TARGET)))
        .groupBy("on_target")
        .agg(rows().alias("n"))
    )


def _totals(clean: DataFrame, keys: Sequence[str], tie: str, nulls: str) -> DataFrame:
    return clean.groupBy(*keys).agg(
        rows().alias("shots"),
        count_true(scored(), nulls).alias("goals"),
        total("xg", nulls).alias("xg_sum"),
        *[count_true(c, nulls).alias(name) for name, c in finishing(tie).items()],
    )


def _season_rates(totals: DataFrame, nulls: str) -> DataFrame:
    """Per-shot rates of each country and season, from totals of any finer grain."""
    measures = {"goals_avg": "goals"} | {f"{c}_avg": c for c in totals.columns if c.endswith(("_target", "_value"))}
    summed = totals.groupBy(*SEASON_KEYS).agg(
        F.sum("shots").alias("shots"), *[total(c, nulls).alias(name) for name, c in measures.items()]
    )
    return across(summed, measures, lambda c: per(c, "shots")).drop("shots")


def season_averages(clean: DataFrame, tie: str = "subtracted", nulls: str = "skip") -> DataFrame:
    """Per country and season: goals, misses, value lost and value added per shot."""
    return _season_rates(_totals(clean, SEASON_KEYS, tie, nulls), nulls)


def player_finishing(
    clean: DataFrame,
    min_shots: int | None = None,
    as_points: bool = False,
    tie: str = "subtracted",
    nulls: str = "skip",
    ordered: bool = True,
) -> DataFrame:
    """Per player, squad, country and season: totals against the season's average finishing.

    Best finisher first. ``as_points=True`` gives the points of the model: a lower bar for shots,
    the off-target differences as well, differences in percentage points, worst finisher first.
    ``ordered=False`` leaves the sort out, for a model or filter that does not need it.

    The season averages are summed from the player totals, so the shots are read and shuffled once.
    """
    if min_shots is None:
        min_shots = MIN_SHOTS_POINTS if as_points else MIN_SHOTS_TABLE
    totals = reuse_point(_totals(clean, PLAYER_KEYS, tie, nulls))
    averages = _season_rates(totals, nulls)
    joined = join_natural(totals.filter(F.col("shots") >= min_shots), averages, on=SEASON_KEYS)
    expected = column_range(joined, "goals_avg", "added_value_avg")
    joined = across(joined, expected, lambda c: half_even_2(c * F.col("shots")))
    measured = joined.withColumns(
        {
            "goals_diff": F.col("goals") - F.col("xg_sum"),
            "added_value_diff": F.col("added_value") - F.col("added_value_avg"),
            "added_value_pct": per("added_value", "shots"),
        }
    )
    ppdiff = F.col("added_value_pct") - per("added_value_avg", "shots")
    if not as_points:
        table = measured.withColumn("added_value_ppdiff", ppdiff)
        return arrange(table, "-added_value_ppdiff", *PLAYER_KEYS) if ordered else table
    points = measured.withColumns(
        {
            "off_target_diff": F.col("miss_target") - F.col("miss_target_avg"),
            "off_target_pct": per("miss_target", "shots"),
        }
    ).withColumns(
        {
            "ot_ppdiff": 100 * (F.col("off_target_pct") - per("miss_target_avg", "shots")),
            "added_value_ppdiff": 100 * ppdiff,
        }
    )
    return arrange(points, "added_value_ppdiff", *PLAYER_KEYS) if ordered else points


def finishing_model(
    points: DataFrame,
    y: str = "goals_diff",
    x: str = "added_value_diff",
    y_label: str = Y_LABEL,
    x_label: str = X_LABEL,
) -> DataFrame:
    """One row: the least-squares line of the points, its R squared, both as labels too."""
    return ols(points, y, x).withColumns(
        {
            "equation": label(
                F.lit("Equation:"),
                F.lit(y_label),
                F.lit("="),
                decimals("intercept", 3),
                F.lit("+"),
                decimals("slope", 3),
                F.lit("*"),
                F.lit(x_label),
            ),
            "r_squared_label": label(F.lit("R-squared ="), decimals("r_squared", 3)),
        }
    )


def fitted_points(
    points: DataFrame, y: str = "goals_diff", x: str = "added_value_diff", level: float | None = None
) -> DataFrame:
    """The points with the fitted line's value and the residual."""
    return add_fit(points, y, x, level)


def highlight_player(points: DataFrame, pattern: str) -> DataFrame:
    """Points of the players whose name matches, labelled ``squad - season``."""
    return points.filter(matches("player", pattern)).withColumn("label", label("squad", "season_end_year", sep=" - "))


def player_title(points: DataFrame, pattern: str, title: str) -> DataFrame:
    """Distinct matching names, each with the heading ``name - title``."""
    names = points.filter(matches("player", pattern)).select("player").distinct()
    return names.withColumn("title", label("player", F.lit(title), sep=" - "))


def team_finishing(clean: DataFrame, nulls: str = "skip") -> DataFrame:
    """Per country and squad: goals against xG and against post-shot xG; worst finishers first."""
    summed = clean.groupBy("country", "squad").agg(
        rows().alias("shots"),
        count_true(scored(), nulls).alias("goals"),
        total("xg", nulls).alias("xg"),
        total("psxg", nulls).alias("psxg"),
    )
    diffs = summed.withColumns({"xgdiff": F.col("goals") - F.col("xg"), "psxgdiff": F.col("goals") - F.col("psxg")})
    return arrange(diffs, "psxgdiff", "country", "squad")


def clean_shots_single_league(shots: DataFrame) -> DataFrame:
    """One league's shots as delivered: numeric xG, post-shot xG with blank as 0, ``on_target`` 0/1.

    Unlike in :func:`clean_shots` a null post-shot xG stays null, and so does its ``on_target``.
    """
    named = clean_names(shots)
    text = F.col("p_sx_g")
    psxg = if_else(text.cast("string") == "", F.lit(0.0), num(text))
    numeric = named.withColumns({"x_g": num("x_g"), "p_sx_g": psxg})
    numeric = numeric.withColumnsRenamed({"x_g": "xg", "p_sx_g": "psxg"})
    return numeric.withColumn("on_target", if_else(F.col("psxg") == 0, F.lit(0), F.lit(1)))


def distinct_seasons(shots: DataFrame) -> DataFrame:
    """Which seasons the table covers."""
    return shots.select("season_end_year").distinct()
