"""Declared schemas of the landed tables, columns named as delivered.

Numbers that are delivered as text (blank for missing) are strings here and become
numbers in the cleaning plans. Declaring the schema saves the inference pass over the files.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG, DOUBLE, DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Columns that partition the tables of shots and of results on disk.
LEAGUE_PARTITIONS = ["Country", "Gender", "Tier", "Season_End_Year"]

SHOTS = _struct(
    Match_URL=TEXT,
    Date=DATE,
    Squad=TEXT,
    Home_Away=TEXT,
    Match_Half=INT,
    Minute=INT,
    Player=TEXT,
    xG=TEXT,
    PSxG=TEXT,
    Outcome=TEXT,
    Distance=TEXT,
    Body_Part=TEXT,
    Country=TEXT,
    Gender=TEXT,
    Tier=TEXT,
    Season_End_Year=INT,
)

RESULTS = _struct(
    Date=DATE,
    Home=TEXT,
    Away=TEXT,
    HomeGoals=INT,
    AwayGoals=INT,
    Country=TEXT,
    Gender=TEXT,
    Tier=TEXT,
    Season_End_Year=INT,
)

TEAM_PASSING = _struct(Season_End_Year=INT, Team=TEXT, Home_Team=TEXT, Away_Team=TEXT)

TEAMS = _struct(
    team_id=TEXT,
    team_name=TEXT,
    team_short_name=TEXT,
    team_abbreviation=TEXT,
    competitions=T.ArrayType(TEXT),
)

PLAYERS = _struct(player_id=TEXT, player_name=TEXT, nationality=TEXT)

PLAYER_ACTION = _struct(action_type=TEXT, goals_added_raw=DOUBLE, goals_added_above_avg=DOUBLE, count_actions=LONG)

PLAYER_GOALS_ADDED = _struct(
    player_id=TEXT,
    team_id=TEXT,
    season_name=TEXT,
    general_position=TEXT,
    minutes_played=DOUBLE,
    data=T.ArrayType(PLAYER_ACTION),
)

GOALKEEPER_GOALS_ADDED = _struct(
    player_id=TEXT,
    team_id=T.ArrayType(TEXT),
    season_name=TEXT,
    minutes_played=DOUBLE,
    data=T.ArrayType(PLAYER_ACTION),
)

TEAM_ACTION = _struct(
    action_type=TEXT,
    num_actions_for=LONG,
    goals_added_for=DOUBLE,
    num_actions_against=LONG,
    goals_added_against=DOUBLE,
)

TEAM_GOALS_ADDED = _struct(
    team_id=TEXT, season_name=TEXT, minutes=DOUBLE, data=T.ArrayType(TEAM_ACTION), zone=INT
)

SALARIES = _struct(
    player_id=TEXT,
    team_id=TEXT,
    season_name=INT,
    position=TEXT,
    base_salary=DOUBLE,
    guaranteed_compensation=DOUBLE,
    mlspa_release=DATE,
)

# The header holds names with spaces.
SCORECARD = T.StructType(
    [T.StructField(name, INT) for name in "Hole Par Yardage Handicap Score Putts Partials Fulls".split()]
    + [
        T.StructField("Tee Direction", TEXT),
        T.StructField("Drops from Tee", INT),
        T.StructField("Drops from Approach", INT),
        T.StructField("Drop from Partial", INT),
    ]
)

ROUNDS = _struct(
    round_id=TEXT,
    course=TEXT,
    round_datetime=TEXT,
    tees=TEXT,
    slope=INT,
    rating=DOUBLE,
    pc_coeff=INT,
    handicap_index=DOUBLE,
)

POSTS = _struct(title=TEXT, author=TEXT, date=DATE, categories=T.ArrayType(TEXT))
