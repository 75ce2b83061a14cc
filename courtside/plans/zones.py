"""Goals added against, per team and pitch zone, compared with the league."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import mean, per, per96, sd, sum_of
from courtside.operators import join_natural, pivot_nested, pivot_wider, reuse_point, unnest

# Pitch zones, and the actions summed against a team, in order.
ZONES = range(1, 31)
AGAINST_ACTIONS = ["Fouling", "Receiving", "Passing", "Dribbling", "Shooting"]

AGAINST = "goals_added_against"
OTHER_MEASURES = ["num_actions_for", "goals_added_for", "num_actions_against"]


def team_zone_long(team_goals_added: DataFrame, zones: Iterable[int] | None = None) -> DataFrame:
    """A row per team, season, zone and action, of all zones or those given. One scan; zones select partitions of the source."""
    if zones is not None:
        team_goals_added = team_goals_added.filter(F.col("zone").isin(list(zones)))
    return unnest(team_goals_added, "data")


def zone_goals_against(
    team_zones: DataFrame, teams: DataFrame, season: int, actions: Sequence[str] = AGAINST_ACTIONS
) -> DataFrame:
    """One season's teams and zones: goals added against per action (absent: 0), their sum, and per 96 minutes.

    Takes the nested table, which needs no shuffle, or the output of :func:`team_zone_long`.
    The team attributes are joined after the pivot; they follow from ``team_id``.
    """
    one = team_zones.filter(F.col("season_name") == str(season))
    if "data" in team_zones.columns:
        wide = pivot_nested(one, "data", "action_type", AGAINST, actions, fill=0.0)
    else:
        wide = pivot_wider(one.drop(*OTHER_MEASURES), "action_type", AGAINST, actions, fill=0.0)
    named = join_natural(wide, teams.drop("competitions"), on=["team_id"], null_keys="never")
    summed = named.withColumn("team_goals_added_against", sum_of(actions))
    return summed.withColumn("tgaa_96", per96("team_goals_added_against", "minutes"))


def zone_league_average(against: DataFrame, nulls: str = "skip") -> DataFrame:
    """Per zone: league mean of goals added against, per 96 minutes and raw, over the rows as they are."""
    return against.groupBy("zone").agg(
        mean("tgaa_96", nulls).alias("lg_avg_gaa_96"), mean("team_goals_added_against", nulls).alias("lg_avg_gaa")
    )


def _team_sums(against: DataFrame) -> DataFrame:
    """Per team and zone: sum, count and missing values of both measures. All zone statistics follow from these."""
    measures = {"96": "tgaa_96", "raw": "team_goals_added_against"}
    states = []
    for name, c in measures.items():
        states += [F.sum(c).alias(f"sum_{name}"), F.count(c).alias(f"n_{name}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{name}")]
    return reuse_point(against.groupBy("team_abbreviation", "zone").agg(*states))


def _team_mean(measure: str, nulls: str) -> Column:
    """The mean of a team and zone from its state; under ``propagate`` null as soon as one value is missing."""
    found = per(f"sum_{measure}", f"n_{measure}")
    return F.when(F.col(f"nulls_{measure}") == 0, found) if nulls == "propagate" else found


def _zone_stats(team_sums: DataFrame, nulls: str) -> DataFrame:
    """Per zone: league means over the zone's rows, mean and deviation of the teams' differences.

    The league's mean is one number per zone. So the differences from it deviate as the teams'
    means do, and their mean is the league's mean less the mean of the teams' means: one
    aggregation gives both, without joining the league's mean to the teams first.
    """

    def league(measure: str) -> Column:
        found = per(F.sum(f"sum_{measure}"), F.sum(f"n_{measure}"))
        return F.when(F.sum(f"nulls_{measure}") == 0, found) if nulls == "propagate" else found

    team_mean = _team_mean("raw", nulls)
    stats = team_sums.groupBy("zone").agg(
        league("96").alias("lg_avg_gaa_96"),
        league("raw").alias("lg_avg_gaa"),
        mean(team_mean, nulls).alias("mean_of_teams"),
        sd(team_mean, nulls).alias("sd_gaa"),
    )
    return stats.select(
        "zone",
        "lg_avg_gaa_96",
        "lg_avg_gaa",
        (F.col("lg_avg_gaa") - F.col("mean_of_teams")).alias("mean_gaa"),
        "sd_gaa",
    )


def _known_rule(nulls: str) -> str:
    if nulls not in ("skip", "propagate"):
        raise ValueError(f"nulls must be 'skip' or 'propagate', not {nulls!r}")
    return nulls


def zone_spread(against: DataFrame, nulls: str = "skip") -> DataFrame:
    """Per zone: mean and standard deviation of the teams' differences from the league.

    ``nulls="propagate"`` leaves both missing in a zone where one value is, as :func:`zone_league_average` does.
    """
    return _zone_stats(_team_sums(against), _known_rule(nulls)).select("zone", "mean_gaa", "sd_gaa")


def zone_zscores(against: DataFrame, team: str | None = None, nulls: str = "skip") -> DataFrame:
    """Per team and zone: its means, the league's, the differences, the zone's spread and the z-score.

    All teams or one. ``against`` is computed once: the zone's statistics come from the sums per team. The null rule is
    that of :func:`zone_spread`.
    """
    sums = _team_sums(against)
    teams = sums.select(
        "team_abbreviation",
        "zone",
        _team_mean("96", _known_rule(nulls)).alias("avg_gaa_96"),
        _team_mean("raw", nulls).alias("avg_gaa"),
    )
    if team is not None:
        teams = teams.filter(F.col("team_abbreviation") == team)
    compared = join_natural(teams, _zone_stats(sums, nulls), on=["zone"]).withColumns(
        {
            "gaa_vs_lg_avg": F.col("lg_avg_gaa") - F.col("avg_gaa"),
            "gvla_96": F.col("lg_avg_gaa_96") - F.col("avg_gaa_96"),
        }
    )
    return compared.withColumn("sd_above_mean", per(F.col("gaa_vs_lg_avg") - F.col("mean_gaa"), "sd_gaa"))
