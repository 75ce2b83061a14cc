"""Match results seen by both teams, and shots joined to the opponent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions import count_true, if_else, per, rows, scored, total
from courtside.operators import add_totals, join_natural, two_sides

# Fixed value: a league's shots on target and shots, whose ratio is the expected rate.
LEAGUE_SHOTS_ON_TARGET = (5505, 16002)


def two_sided_results(results: DataFrame) -> DataFrame:
    """One match row to a home row and an away row. One pass over the matches."""
    home = {
        "date": F.col("date"),
        "team": F.col("home"),
        "opponent": F.col("away"),
        "gf": F.col("home_goals"),
        "ga": F.col("away_goals"),
        "home_away": F.lit("Home"),
    }
    away = {
        "date": F.col("date"),
        "team": F.col("away"),
        "opponent": F.col("home"),
        "gf": F.col("away_goals"),
        "ga": F.col("home_goals"),
        "home_away": F.lit("Away"),
    }
    return two_sides(results, [home, away])


def shots_with_opponent(
    shots: DataFrame, two_sided: DataFrame, null_keys: str = "never", unique: bool = False
) -> DataFrame:
    """Shots with the result of the squad's match that day; a squad with two matches gets both.

    ``unique`` makes the query fail where a squad has two matches on a day; ``null_keys`` as in
    :func:`~courtside.operators.join_natural`.
    """
    results = two_sided.withColumnRenamed("team", "squad")
    return join_natural(shots, results, on=["date", "squad"], null_keys=null_keys, unique_right=unique)


def shots_allowed(
    shots: DataFrame,
    two_sided: DataFrame,
    season: int,
    sot_rate: tuple[int, int] = LEAGUE_SHOTS_ON_TARGET,
    totals: str | None = "recompute",
    nulls: str = "skip",
) -> DataFrame:
    """Per opponent in one season: shots, shots on target, goals and xG allowed, with a totals row.

    ``shots`` come from :func:`~courtside.plans.shots.clean_shots_single_league`. They are summed
    per squad and day before the join to the opponent, which leaves every sum the same
    and joins a row per squad and day instead of one per shot. ``totals`` is the mode of
    :func:`~courtside.operators.add_totals`, or ``None`` for no totals row.
    """
    daily = (
        shots.filter(F.col("season_end_year") == season)
        .groupBy("season_end_year", "date", "squad")
        .agg(
            rows().alias("shots"),
            total("on_target", nulls).alias("sot"),
            count_true(scored(), nulls).alias("goals"),
            total("xg", nulls).alias("xg"),
        )
    )
    allowed = (
        shots_with_opponent(daily, two_sided.select("date", "team", "opponent"))
        .groupBy("season_end_year", "opponent")
        .agg(
            F.sum("shots").alias("shots_allowed"),
            total("sot", nulls).alias("sot_allowed"),
            total("goals", nulls).alias("goals_allowed"),
            total("xg", nulls).alias("xg_allowed"),
        )
    )
    ratios = {
        "shot_pct": per("goals_allowed", "shots_allowed"),
        "sot_pct": per("sot_allowed", "shots_allowed"),
        "gl_sot_pct": per("goals_allowed", "sot_allowed"),
    }
    hits, of = sot_rate
    rated = expected_on_target(allowed.withColumns(ratios), "shots_allowed", "sot_allowed", (hits, of))
    return rated if totals is None else add_totals(rated, ratios, totals)


def expected_on_target(
    df: DataFrame, shots: str, on_target: str, sot_rate: tuple[int, int] = LEAGUE_SHOTS_ON_TARGET
) -> DataFrame:
    """Add the shots on target a league rate expects, and what was seen beyond it."""
    hits, of = sot_rate
    return df.withColumn("sot_exp", F.col(shots) * hits / of).withColumn("sot_res", F.col(on_target) - F.col("sot_exp"))


def team_match_opponent(team_stats: DataFrame, season: int) -> DataFrame:
    """One season of team-match rows with the other team's name."""
    other = if_else(F.col("team") == F.col("home_team"), F.col("away_team"), F.col("home_team"))
    return team_stats.filter(F.col("season_end_year") == season).withColumn("opponent", other)
