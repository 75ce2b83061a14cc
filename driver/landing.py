"""The views written as the files that courtside's readers expect, and read back through them.

Each query lands its table in the session's shared folder in the source's layout (partitions, nesting, text), then reads it by
:mod:`courtside.sources`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import operators as op
from courtside import plans, sources
from courtside.sources import schemas
from driver import views


#: Folders that one task writes to at a time. Without this Spark sorts all rows of a task by folder, and spills them where they
#: are many; a task that meets more folders sorts the rest of its rows.
OPEN_FOLDERS = 64
OPEN_SETTING = "spark.sql.maxConcurrentOutputFileWriters"


def land(df: DataFrame, name: str, fmt: str = "parquet", by: list[str] | None = None, **options: str) -> str:
    spark = df.sparkSession
    path = f"{op.shared_folder(spark)}/landed-{name}-{uuid.uuid4().hex}"
    writer = df.write.format(fmt).options(**options)
    before = spark.conf.get(OPEN_SETTING)
    spark.conf.set(OPEN_SETTING, str(OPEN_FOLDERS))
    try:
        (writer.partitionBy(*by) if by else writer).save(path)
    finally:
        spark.conf.set(OPEN_SETTING, before)
    return path


def _day(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def shots_path(spark: SparkSession, sf: str) -> str:
    return land(views.shots(spark, sf), "shots", by=schemas.LEAGUE_PARTITIONS)


def late_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """A table of seasons, filtered: the partitions to read are known when the query runs."""
    return views.results(spark, sf).filter("season_end_year >= 1996").select("season_end_year").distinct()


def source_shots(spark, sf):
    found = sources.shots(spark, shots_path(spark, sf), country="O", seasons=late_seasons(spark, sf))
    return _day(op.clean_names(found), "date").drop("p_sx_g")


def source_results(spark, sf):
    made = views.results(spark, sf).selectExpr(
        "date AS Date", "home AS Home", "away AS Away", "home_goals AS HomeGoals", "away_goals AS AwayGoals", "'USA' AS Country", "'M' AS Gender",
        "'1st' AS Tier", "season_end_year AS Season_End_Year",
    )
    path = land(made, "results", by=schemas.LEAGUE_PARTITIONS)
    return _day(sources.results(spark, path, country="USA", gender="M", seasons=range(1995, 1998)), "date")


def source_teams(spark, sf):
    return sources.teams(spark, land(views.teams(spark, sf), "teams")).drop("competitions")


def source_players(spark, sf):
    return sources.players(spark, land(views.players(spark, sf), "players", "orc"), fmt="orc")


def source_player_goals_added(spark, sf):
    path = land(views.player_goals_added(spark, sf), "player-goals-added", by=["season_name"])
    found = sources.player_goals_added(spark, path, seasons=late_seasons(spark, sf))
    return op.unnest(found, "data")


def source_goalkeeper_goals_added(spark, sf):
    path = land(views.goalkeeper_goals_added(spark, sf), "goalkeeper-goals-added", "json")
    found = sources.goalkeeper_goals_added(spark, path, seasons=[1997, 1998], fmt="json")
    return op.unnest(op.unnest_vector(found, "team_id"), "data")


def zones_path(spark: SparkSession, sf: str) -> str:
    return land(views.team_goals_added(spark, sf), "team-goals-added", by=["zone"])


def wanted_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of one event type, of the table of events."""
    return views.table(spark, sf, "events").filter("event_id < 12").selectExpr("CAST(event_id % 30 + 1 AS int) AS zone").distinct()


def source_team_goals_added(spark, sf):
    return plans.team_zone_long(sources.team_goals_added(spark, zones_path(spark, sf), zones=wanted_zones(spark, sf)))


def source_salaries(spark, sf):
    path = land(views.salaries(spark, sf), "salaries", by=["season_name"])
    return _day(sources.salaries(spark, path, seasons=[1996, 1998]), "mlspa_release").drop("position")


def source_rounds(spark, sf):
    made = views.rounds(spark, sf).selectExpr(
        "CAST(round_id AS string) AS round_id", "'links' AS course", "concat(date_format(timestamp_seconds(round_id * 3600), 'yyyy-MM-dd HH:mm:ss'), ' EST') AS round_datetime",
        "'blue' AS tees", "slope", "rating", "pc_coeff", "handicap_index",
    )
    found = sources.rounds(spark, land(made, "rounds", "json"))
    return found.select("round_id", "slope", "rating", F.unix_seconds("round_datetime").alias("seconds"))


def source_posts(spark, sf):
    found = sources.posts(spark, land(views.posts(spark, sf), "posts", "json"))
    return plans.category_counts(found)


def team_csv(spark: SparkSession, sf: str) -> str:
    """Team statistics as text, with the seasons of some matches unreadable."""
    made = views.results(spark, sf).selectExpr(
        "CASE WHEN home_goals = 3 AND away = 'T1' THEN 'n/a' WHEN home_goals = 4 THEN '' ELSE CAST(season_end_year AS string) END AS Season_End_Year",
        "explode(array(home, away)) AS Team", "home AS Home_Team", "away AS Away_Team", "home_goals AS Goals",
    )
    return land(made, "team-passing", "csv", header="true")


def source_team_passing(spark, sf):
    found = sources.team_passing(spark, team_csv(spark, sf), rescue=True)
    return found.select("team", "home_team", "away_team", F.coalesce("season_end_year", F.lit(-1)).alias("season_end_year"), F.size("bad_values").alias("bad"))


def source_bad_values(spark, sf):
    return sources.bad_value_counts(sources.team_passing(spark, team_csv(spark, sf), rescue=True))


def source_scorecards(spark, sf):
    made = views.table(spark, sf, "lineitem").selectExpr(
        "l_linenumber AS Hole", "3 + l_linenumber % 3 AS Par", "CAST(l_extendedprice AS int) AS Yardage", "l_linenumber AS Handicap",
        "CAST(l_quantity AS int) AS Score", "1 AS Putts", "0 AS Partials", "2 AS Fulls", "l_returnflag AS `Tee Direction`",
        "0 AS `Drops from Tee`", "0 AS `Drops from Approach`", "0 AS `Drop from Partial`",
    )
    cards = sources.scorecards(spark, land(made, "scorecards", "csv", header="true"))
    return cards.groupBy("hole", "tee_direction").agg(F.count("*").alias("n"), F.sum("par").alias("par"), F.sum("score").alias("score"))


QUERIES = [
    source_shots,
    source_results,
    source_teams,
    source_players,
    source_player_goals_added,
    source_goalkeeper_goals_added,
    source_team_goals_added,
    source_salaries,
    source_rounds,
    source_posts,
    source_team_passing,
    source_bad_values,
    source_scorecards,
]
