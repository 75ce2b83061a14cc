"""The driver's tables as the library's input tables.

Every view keeps all rows of its table. Teams, squads and players are derived from keys that
grow with the data, so rows per key stay about the same at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import plans

# Action names and the driver's event types that stand for them.
EVENT_ACTIONS = {
    "Dribbling": "event_type = 'click' AND event_id % 2 = 0",
    "Fouling": "event_type = 'click' AND event_id % 2 = 1",
    "Interrupting": "event_type = 'error'",
    "Passing": "event_type = 'view'",
    "Receiving": "event_type = 'purchase'",
    "Shooting": "event_type = 'signup'",
}


# Declared, so that no job reads a file's footer to infer them while a query is being built.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as shots, as delivered: numbers as text, blank post-shot xG off target, ``(pen)`` in names."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('match-', l_orderkey) AS Match_URL",
        "CAST(l_shipdate AS date) AS Date",
        "concat('T', l_suppkey div 10) AS Squad",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'Home' ELSE 'Away' END AS Home_Away",
        "CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS Match_Half",
        "CAST(l_quantity AS int) AS Minute",
        "concat('P', l_suppkey, CASE WHEN l_linenumber = 7 THEN ' (pen)' ELSE '' END) AS Player",
        "CAST(l_discount AS string) AS xG",
        "CASE WHEN l_tax = 0 THEN '' ELSE CAST(l_tax AS string) END AS PSxG",
        "CASE l_returnflag WHEN 'R' THEN 'Goal' WHEN 'A' THEN 'Saved' ELSE 'Off Target' END AS Outcome",
        "CAST(CAST(l_quantity AS int) AS string) AS Distance",
        "CASE l_linenumber % 3 WHEN 0 THEN 'Head' WHEN 1 THEN 'Left Foot' ELSE 'Right Foot' END AS Body_Part",
        "l_linestatus AS Country",
        "'M' AS Gender",
        "'1st' AS Tier",
        "year(l_shipdate) AS Season_End_Year",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as matches; a team that would meet itself meets the next one."""
    matches = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderdate AS date) AS date",
        "o_custkey div 150 AS home",
        "o_orderkey div 1500 AS away",
        "CAST(o_orderkey % 5 AS int) AS home_goals",
        "CAST(o_custkey % 4 AS int) AS away_goals",
        "year(o_orderdate) AS season_end_year",
    )
    return matches.selectExpr(
        "date",
        "concat('T', home) AS home",
        "concat('T', CASE WHEN away = home THEN home + 1 ELSE away END) AS away",
        "home_goals",
        "away_goals",
        "season_end_year",
    )


def team_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per team and match."""
    return results(spark, sf_dir).selectExpr(
        "season_end_year", "explode(array(home, away)) AS team", "home AS home_team", "away AS away_team"
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS string) AS team_id",
        "n_name AS team_name",
        "lower(n_name) AS team_short_name",
        "concat('N', n_nationkey) AS team_abbreviation",
        "array('league') AS competitions",
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS string) AS player_id",
        "c_name AS player_name",
        "concat('NAT', c_nationkey) AS nationality",
    )


def _money(condition: str | None = None) -> str:
    value = "CAST(value AS decimal(18,2))"
    return f"sum({value})" if condition is None else f"sum(CASE WHEN {condition} THEN {value} END)"


def player_goals_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per user and season (week), one nested row each; absent actions are not in the array."""
    counts = [f"count_if({c}) AS n_{a}" for a, c in EVENT_ACTIONS.items()]
    sums = [f"{_money(c)} AS v_{a}" for a, c in EVENT_ACTIONS.items()]
    grouped = (
        table(spark, sf_dir, "events")
        .selectExpr("user_id", "1995 + weekofyear(ts) AS season", "event_type", "event_id", "value")
        .groupBy("user_id", "season")
        .agg(F.expr("count(*) AS n"), *map(F.expr, counts), *map(F.expr, sums))
    )
    actions = ", ".join(
        f"named_struct('action_type', '{a}', 'goals_added_raw', CAST(v_{a} AS double), 'goals_added_above_avg', "
        f"CAST(v_{a} - 20 * n_{a} AS double), 'count_actions', n_{a})"
        for a in EVENT_ACTIONS
    )
    return grouped.selectExpr(
        "CAST(user_id AS string) AS player_id",
        "CAST(user_id % 25 AS string) AS team_id",
        "CAST(season AS string) AS season_name",
        "element_at(array('GK', 'CB', 'CM', 'ST'), CAST(user_id % 4 AS int) + 1) AS general_position",
        "CAST(90 * n AS double) AS minutes_played",
        f"filter(array({actions}), a -> a.count_actions > 0) AS data",
    )


def goalkeeper_goals_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with two teams each."""
    return player_goals_added(spark, sf_dir).selectExpr(
        "player_id",
        "array(team_id, CAST((CAST(team_id AS int) + 7) % 25 AS string)) AS team_id",
        "season_name",
        "minutes_played",
        "data",
    )


def team_goals_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per team and zone, one nested row each."""
    parts = []
    for a, c in EVENT_ACTIONS.items():
        parts += [
            f"count_if({c}) AS n_{a}",
            f"{_money(f'({c})')} AS v_{a}",
            f"count_if(({c}) AND value > 20) AS m_{a}",
        ]
    grouped = (
        table(spark, sf_dir, "events")
        .selectExpr("user_id % 25 AS team", "event_id % 30 + 1 AS zone", "year(ts) AS season", "event_type", "event_id", "value")
        .groupBy("team", "zone", "season")
        .agg(F.expr("count(*) AS n"), *map(F.expr, parts))
    )
    actions = ", ".join(
        f"named_struct('action_type', '{a}', 'num_actions_for', m_{a}, 'goals_added_for', CAST(m_{a} AS double) / 10, "
        f"'num_actions_against', n_{a}, 'goals_added_against', CAST(v_{a} AS double))"
        for a in EVENT_ACTIONS
    )
    return grouped.selectExpr(
        "CAST(team AS string) AS team_id",
        "CAST(season AS string) AS season_name",
        "CAST(90 * n AS double) AS minutes",
        f"filter(array({actions}), a -> a.num_actions_against > 0) AS data",
        "CAST(zone AS int) AS zone",
    )


def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS string) AS player_id",
        "CAST(o_custkey % 25 AS string) AS team_id",
        "year(o_orderdate) AS season_name",
        "o_totalprice AS base_salary",
        "o_totalprice * 1.1D AS guaranteed_compensation",
        "CAST(o_orderdate AS date) AS mlspa_release",
    )


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS round_id", "l_linenumber AS hole", "3 + l_linenumber % 3 AS par"
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS round_id",
        "CAST(113 + o_orderkey % 30 AS int) AS slope",
        "CAST(68 + o_custkey % 8 AS double) + 0.5D AS rating",
        "CAST(o_orderkey % 4 AS int) AS pc_coeff",
        "CAST(o_custkey % 37 AS double) + 0.3D AS handicap_index",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc-', doc_id) AS title",
        "source AS author",
        "date_add(DATE '2000-01-01', CAST(n_chars AS int)) AS date",
        "array(lang, source) AS categories",
    )


def shots_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned shots of which some miss their squad, xG or outcome."""
    missing = {"squad": "minute % 13 = 0", "xg": "minute % 11 = 0 AND squad <> 'T1'", "outcome": "minute % 7 = 0"}
    cleaned = plans.clean_shots_single_league(shots(spark, sf_dir))
    return cleaned.selectExpr("*").withColumns({c: F.expr(f"CASE WHEN NOT coalesce({rule}, false) THEN {c} END") for c, rule in reversed(missing.items())})


def results_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match results of which some do not name the home team."""
    return results(spark, sf_dir).withColumn("home", F.expr("CASE WHEN home <> 'T2' THEN home END"))


def salaries_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries of which some miss the day of their release."""
    return salaries(spark, sf_dir).withColumn("mlspa_release", F.expr("CASE WHEN base_salary > 30000 THEN mlspa_release END"))


def team_goals_added_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of which some miss the minutes, and others the goals added by passing."""
    hide = "transform(data, a -> named_struct('action_type', a.action_type, 'num_actions_for', a.num_actions_for, 'goals_added_for', a.goals_added_for, 'num_actions_against', a.num_actions_against, 'goals_added_against', CASE WHEN a.action_type <> 'Passing' THEN a.goals_added_against END))"
    return team_goals_added(spark, sf_dir).selectExpr(
        "team_id",
        "season_name",
        "CASE WHEN zone % 5 <> 0 OR team_id <> '3' THEN minutes END AS minutes",
        f"CASE WHEN zone % 7 = 0 AND team_id = '4' THEN {hide} ELSE data END AS data",
        "zone",
    )
