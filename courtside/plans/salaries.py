"""Salaries: one season with attributes, a team's wage bill, bands of pay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions import as_column, mean, rows
from courtside.operators import arrange, join_natural, keep_group_max, positions, top

PLAYER_COLUMNS = ["player_id", "player_name", "nationality"]

# Bands of base salary in thousands (low included, high not) and the
# marks of goals added.
SALARY_BANDS = [("low", 65, 300), ("middle", 300, 1000), ("high", 1000, 2000)]
OUTPUT_LINES = [1.82, 3.6, 6.78]

# The row of players whose pay lies in no band or is missing.
OUTSIDE = "outside"


def first_four(teams: DataFrame) -> DataFrame:
    """The first four columns of the table of teams: id and the three names."""
    return teams.select(*positions(teams, 1, 4))


def season_salaries(
    salaries: DataFrame, players: DataFrame, teams: DataFrame, season: int, null_keys: str = "never"
) -> DataFrame:
    """One season's salaries, all releases, with player and team attributes."""
    one = salaries.filter(F.col("season_name") == season)
    named = join_natural(one, players.select(*PLAYER_COLUMNS), null_keys=null_keys)
    return join_natural(named, first_four(teams), null_keys=null_keys)


def team_wage_bill(season_salaries: DataFrame, team: str, n: int | None = None) -> DataFrame:
    """One team's players by the latest release, best paid first: all of them, or the first ``n``."""
    roster = season_salaries.filter(F.col("team_abbreviation") == team)
    latest = keep_group_max(roster, ["player_id"], "mlspa_release")
    order = ("-guaranteed_compensation", "player_id")
    return arrange(latest, *order) if n is None else top(latest, n, *order)


def label_bands(
    points: DataFrame,
    bands: Sequence[tuple[str, float, float]] = SALARY_BANDS,
    lines: Sequence[float] = OUTPUT_LINES,
    salary: str = "salary",
    output: str = "gadd_player",
) -> DataFrame:
    """Add the band of pay each player is in and the highest mark the output reaches, null for none.

    The bands are a short list of disjoint intervals, so this is a projection, not a range join.
    """
    ordered = sorted(bands, key=lambda band: band[1])
    if any(low >= high for _, low, high in ordered) or any(
        a[2] > b[1] for a, b in zip(ordered, ordered[1:])
    ):
        raise ValueError("bands must be disjoint intervals with low < high")
    pay, made = as_column(salary), as_column(output)
    band = F
    for name, low, high in ordered:
        band = band.when((pay >= low) & (pay < high), F.lit(name))
    line = F
    for mark in sorted(lines, reverse=True):
        line = line.when(made >= mark, F.lit(float(mark)))
    return points.withColumns({"salary_band": band, "line_reached": line})


def salary_bands(
    points: DataFrame,
    bands: Sequence[tuple[str, float, float]] = SALARY_BANDS,
    lines: Sequence[float] = OUTPUT_LINES,
    salary: str = "salary",
    output: str = "gadd_player",
) -> DataFrame:
    """Per band of pay: players, mean output, highest mark any of them reaches.

    Pay outside all bands, or missing, has the row ``outside``: the players add up to the rows of ``points``.
    """
    return (
        label_bands(points, bands, lines, salary, output)
        .withColumn("salary_band", F.coalesce("salary_band", F.lit(OUTSIDE)))
        .groupBy("salary_band")
        .agg(
            rows().alias("players"),
            mean(output).alias("mean_output"),
            F.max("line_reached").alias("line_reached"),
        )
    )
