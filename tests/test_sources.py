"""Readers: declared schemas, partition pruning, landed formats."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside import plans, sources
from courtside.sources import schemas
from fixtures import goalkeeper_goals_added, player_goals_added, players, salaries, shots, team_goals_added, teams
from helpers import final_plan, rows


@pytest.fixture
def landed_shots(spark, tmp_path):
    path = str(tmp_path / "shots")
    shots(spark).write.partitionBy(*schemas.LEAGUE_PARTITIONS).parquet(path)
    return path


def _partition_filters(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("PartitionFilters: [")[1].split("]")[0]


def test_shots_prune_partitions(spark, landed_shots):
    found = sources.shots(spark, landed_shots, country=["ESP", "ENG"], gender="M", tier="1st", seasons=range(2022, 2024))
    assert set(found.columns) == set(schemas.SHOTS.fieldNames())
    filters = _partition_filters(found)
    for name in schemas.LEAGUE_PARTITIONS:
        assert name in filters
    assert found.count() == 8
    assert sources.shots(spark, landed_shots, country="ESP", seasons=2022).count() == 1
    assert sources.shots(spark, landed_shots).count() == 8


def test_filters_after_cleaning_still_prune(spark, landed_shots):
    clean = plans.clean_shots(sources.shots(spark, landed_shots)).filter(F.col("season_end_year") == 2022)
    assert "Season_End_Year" in _partition_filters(clean)
    averages = plans.season_averages(plans.clean_shots(sources.shots(spark, landed_shots))).filter("country = 'ENG'")
    assert "Country" in _partition_filters(averages)


def test_queries_read_only_the_columns_they_need(spark, landed_shots):
    counts = plans.on_target_by_outcome(plans.clean_shots(sources.shots(spark, landed_shots)))
    assert "ReadSchema: struct<Outcome:string>" in final_plan(counts)


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    made = spark.createDataFrame(
        [(None, "A", "B", 1, 0, "USA", "M", "1st", 2023), (None, "B", "A", 2, 0, "USA", "M", "1st", 2022)], schemas.RESULTS
    )
    made.write.partitionBy(*schemas.LEAGUE_PARTITIONS).parquet(path)
    found = sources.results(spark, path, country="USA", seasons=[2023])
    assert "home_goals" in found.columns and "season_end_year" in found.columns
    assert found.count() == 1
    assert plans.two_sided_results(found).count() == 2


def test_team_zones_are_one_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "zones")
    team_goals_added(spark).write.partitionBy("zone").parquet(path)
    found = sources.team_goals_added(spark, path)
    assert found.count() == 8  # all zones unless asked otherwise
    assert sources.team_goals_added(spark, path, zones=range(1, 31)).count() == 7
    one = sources.team_goals_added(spark, path, zones=[2], seasons=2023)
    assert "zone" in _partition_filters(one)
    assert one.count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_nested_tables_in_every_format(spark, tmp_path, fmt):
    for name, made in {
        "player_goals_added": player_goals_added(spark),
        "goalkeeper_goals_added": goalkeeper_goals_added(spark),
        "salaries": salaries(spark),
        "teams": teams(spark),
        "players": players(spark),
    }.items():
        path = str(tmp_path / name)
        made.write.format(fmt).save(path)
        found = getattr(sources, name)(spark, path, fmt=fmt)
        assert found.schema.simpleString() == made.schema.simpleString()
        assert rows(found) == rows(made)
    with pytest.raises(ValueError):
        sources.teams(spark, str(tmp_path), fmt="xls")


def test_season_filters_of_the_plans_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "ga")
    player_goals_added(spark).write.parquet(path)
    keepers = str(tmp_path / "gk")
    goalkeeper_goals_added(spark).write.parquet(keepers)
    moments = plans.goals_added_moments(sources.player_goals_added(spark, path), 2023)
    assert "EqualTo(season_name,2023)" in final_plan(moments)
    long = plans.goalkeeper_rows(sources.goalkeeper_goals_added(spark, keepers), players(spark), teams(spark), [2022, 2023])
    assert "In(season_name, [2022,2023])" in final_plan(long)


def test_only_the_needed_fields_of_the_actions_are_read(spark, tmp_path):
    path = str(tmp_path / "ga")
    player_goals_added(spark).write.parquet(path)
    keepers = str(tmp_path / "gk")
    goalkeeper_goals_added(spark).write.parquet(keepers)
    moments = plans.goals_added_moments(sources.player_goals_added(spark, path), 2023)
    fields = "data:array<struct<action_type:string,goals_added_raw:double>>"
    assert fields in final_plan(moments)
    summed = plans.goalkeeper_goals_added(sources.goalkeeper_goals_added(spark, keepers), players(spark), teams(spark), [2023])
    assert "data:array<struct<goals_added_raw:double>>" in final_plan(summed)


def test_season_parameters(spark, tmp_path):
    path = str(tmp_path / "ga")
    player_goals_added(spark).write.parquet(path)
    assert sources.player_goals_added(spark, path, seasons=2022).count() == 1
    assert sources.player_goals_added(spark, path, seasons=[2022, 2023]).count() == 6
    pay = str(tmp_path / "pay")
    salaries(spark).write.parquet(pay)
    assert sources.salaries(spark, pay, seasons=2022).count() == 1


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Team,xG,Season_End_Year,Away_Team,Home_Team\nA,1.5,2023,B,A\nB,0.5,2023,B,A\n")
    found = sources.team_passing(spark, str(tmp_path))
    assert found.columns == ["season_end_year", "team", "home_team", "away_team"]
    assert rows(plans.team_match_opponent(found, 2023)) == [(2023, "A", "A", "B", "B"), (2023, "B", "A", "B", "A")]
    (tmp_path / "b.csv").write_text("Team,xG\nA,1\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        sources.team_passing(spark, str(tmp_path)).collect()


def test_posts(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"title": "T", "author": "A", "date": "2024-01-29", "categories": ["golf"]}')
    found = sources.posts(spark, str(tmp_path))
    assert rows(plans.category_counts(found)) == [("All", 1), ("golf", 1)]


def test_cells_that_cannot_be_read_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Team,Season_End_Year,Away_Team,Home_Team,Goals\nA,2023,B,A,1\nB,20x3,B,A,two\nC,,B,A,3\nD,n/a,B,A,4\n")
    found = sources.team_passing(spark, str(tmp_path), [T.StructField("Goals", T.IntegerType())], rescue=True)
    assert found.columns == ["season_end_year", "team", "home_team", "away_team", "goals", "bad_values"]
    by_team = {r.team: (r.season_end_year, r.goals, [tuple(v) for v in r.bad_values]) for r in found.collect()}
    assert by_team["A"] == (2023, 1, []) and by_team["C"] == (None, 3, [])
    assert by_team["B"] == (None, None, [("season_end_year", "20x3"), ("goals", "two")])
    assert rows(sources.bad_value_counts(found)) == [("goals", 1, "two"), ("season_end_year", 2, "20x3")]
    assert "bad_values" not in sources.team_passing(spark, str(tmp_path)).columns
    assert sources.scorecards(spark, _card(tmp_path), rescue=True).select("bad_values").first()[0][0].asDict() == {"column": "drops_from_tee", "text": "none"}


def _card(folder):
    names = schemas.SCORECARD.fieldNames()
    (folder / "cards").mkdir()
    cells = {"Hole": "1", "Tee Direction": "left", "Drops from Tee": "none"}
    (folder / "cards" / "r1.csv").write_text(",".join(names) + "\n" + ",".join(cells.get(n, "") for n in names) + "\n")
    return str(folder / "cards")


def test_seasons_from_a_table(spark, landed_shots):
    seasons = spark.createDataFrame([(2022, "x"), (2023, "y")], "year int, name string").filter("name = 'x'").select("year")
    found = sources.shots(spark, landed_shots, seasons=seasons)
    assert rows(found) == rows(sources.shots(spark, landed_shots, seasons=2022))
    assert "dynamicpruning" in final_plan(found)
