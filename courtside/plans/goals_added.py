"""Goals added per player and goalkeeper, from tables with one nested row per season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import in_thousands, mean, nested_total, nineties, per96, sd, sum_of, total, whole
from courtside.operators import (
    across,
    arrange,
    column_range,
    join_natural,
    keep_group_max,
    pivot_nested,
    unnest,
    unnest_vector,
)
from courtside.plans.salaries import PLAYER_COLUMNS, first_four

# The actions goals added are split into, in the order they are summed.
ACTIONS = ["Dribbling", "Fouling", "Interrupting", "Passing", "Receiving", "Shooting"]
INTERRUPTING = "Interrupting"


def _wide(goals_added: DataFrame, season: int, actions: Sequence[str]) -> DataFrame:
    """One season, one column per action with its raw goals added, their sum, and the sum without interrupting."""
    one = goals_added.filter(F.col("season_name") == str(season))  # text, so the scan can skip row groups
    wide = pivot_nested(one, "data", "action_type", "goals_added_raw", actions)
    wide = wide.withColumn("gadd_player", sum_of(actions))
    return wide.withColumn("gadd_team", F.col("gadd_player") - F.col(INTERRUPTING)).withColumn(
        "season_name", whole("season_name")
    )


def salary_vs_output(
    goals_added: DataFrame,
    season_salaries: DataFrame,
    season: int,
    actions: Sequence[str] = ACTIONS,
    ordered: bool = True,
) -> DataFrame:
    """Every salaried player's latest salary with the season's goals added, if any; highest base first.

    ``ordered=False`` leaves the sort out, for a filter or summary that does not need it.

    The latest release is picked before the join. It depends on the salaries alone and the
    join keeps all of them, so the result is that of picking afterwards, on fewer rows.
    """
    latest = keep_group_max(season_salaries, ["player_id"], "mlspa_release")
    output = _wide(goals_added, season, actions).withColumn("gaddplayer96", per96("gadd_player", "minutes_played"))
    joined = join_natural(output, latest, how="right").withColumns(
        {"salary": in_thousands("base_salary"), "m90s": nineties("minutes_played")}
    )
    return arrange(joined, "-base_salary", "player_id", "team_id") if ordered else joined


def position_filter(salary_output: DataFrame, position: str) -> DataFrame:
    """:func:`salary_vs_output` restricted to one position."""
    return salary_output.filter(F.col("general_position") == position)


def log_salary(salary_output: DataFrame) -> DataFrame:
    """The salary on the logarithmic axis of the salary-output plane."""
    return salary_output.withColumn("log10_salary", F.log10("salary"))


def goals_added_moments(
    goals_added: DataFrame, season: int, actions: Sequence[str] = ACTIONS, nulls: str = "skip"
) -> DataFrame:
    """One row: mean and standard deviation of the season's goals added over all players."""
    return _wide(goals_added, season, actions).agg(
        mean("gadd_player", nulls).alias("mean_gadd_player"), sd("gadd_player", nulls).alias("sd_gadd_player")
    )


def _in_seasons(seasons: Sequence[int]) -> Column:
    return F.col("season_name").isin([str(season) for season in seasons])


def _named(rows: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Add player names and the first four team columns."""
    named = join_natural(rows, players.select(*PLAYER_COLUMNS), null_keys="never")
    return join_natural(named, first_four(teams), null_keys="never")


def goalkeeper_rows(
    goalkeepers: DataFrame, players: DataFrame, teams: DataFrame, seasons: Sequence[int]
) -> DataFrame:
    """Goalkeepers' goals added in long form, a row per action and team, with names and team attributes."""
    chosen = goalkeepers.filter(_in_seasons(seasons))
    return _named(unnest_vector(unnest(chosen, "data"), "team_id"), players, teams)


def goalkeeper_goals_added(
    goalkeepers: DataFrame,
    players: DataFrame,
    teams: DataFrame,
    seasons: Sequence[int],
    where: Column | None = None,
    nulls: str = "skip",
) -> DataFrame:
    """Raw goals added per season and goalkeeper, over the rows ``where`` picks by player and team.

    The sum over :func:`goalkeeper_rows`. A row's actions are added up inside the row, before the
    joins, so these see a row per goalkeeper, season and team and not one per action.
    """
    chosen = goalkeepers.filter(_in_seasons(seasons) & (F.size("data.goals_added_raw") > 0))
    summed = chosen.withColumn("goals_added_raw", nested_total("data", "goals_added_raw", nulls)).drop("data")
    rows = _named(unnest_vector(summed, "team_id"), players, teams)
    if where is not None:
        rows = rows.filter(where)
    return rows.groupBy("season_name", "player_name").agg(total("goals_added_raw", nulls).alias("goals_added_raw"))


def player_goals_added_p96(
    goals_added: DataFrame,
    players: DataFrame,
    teams: DataFrame,
    season: int,
    where: Column | None = None,
    actions: Sequence[str] = ACTIONS,
) -> DataFrame:
    """One season's players with goals added per action, in all and without interrupting, each also per 96 minutes.

    ``where`` picks rows by player and team attributes, say a team's players and one more player
    outside another team. Best total rate first.
    """
    wide = _wide(goals_added, season, actions).withColumnsRenamed(
        {"gadd_player": "goals_added", "gadd_team": "ga_team"}
    )
    named = join_natural(wide, players.select(*PLAYER_COLUMNS), null_keys="never")
    named = join_natural(named, teams, on=["team_id"], null_keys="never")
    if where is not None:
        named = named.filter(where)
    picked = named.select("player_name", "general_position", "minutes_played", *actions, "goals_added", "ga_team")
    measures = column_range(picked, actions[0], "ga_team")
    rates = across(picked, measures, lambda c: per96(c, "minutes_played"), suffix="_p96")
    return arrange(rates, "-goals_added_p96", "player_name", "minutes_played")
