"""Landed tables: declared schemas and readers that prune partitions."""

from courtside.sources import schemas
from courtside.sources.readers import (
    bad_value_counts,
    goalkeeper_goals_added,
    player_goals_added,
    players,
    posts,
    results,
    rounds,
    salaries,
    scorecards,
    shots,
    team_goals_added,
    team_passing,
    teams,
)

__all__ = [
    "bad_value_counts",
    "goalkeeper_goals_added",
    "player_goals_added",
    "players",
    "posts",
    "results",
    "rounds",
    "salaries",
    "schemas",
    "scorecards",
    "shots",
    "team_goals_added",
    "team_passing",
    "teams",
]
