import pytest
from pyspark.sql import functions as F

from courtside import operators as op
from courtside import plans
from courtside.plans.goals_added import ACTIONS
from courtside.plans.zones import OTHER_MEASURES
from fixtures import (
    goalkeeper_goals_added,
    player_goals_added,
    players,
    salaries,
    team_goals_added,
    teams,
)
from helpers import rows


@pytest.fixture
def paid(spark):
    return plans.season_salaries(salaries(spark), players(spark), teams(spark), 2023)


def test_season_salaries_keep_unknown_players(paid):
    assert paid.count() == 6
    stranger = paid.filter("player_id = 'p9'").first()
    assert stranger.player_name is None and stranger.team_abbreviation is None
    assert "competitions" not in paid.columns


def test_wage_bill_is_the_latest_release_best_paid_first(paid):
    bill = plans.team_wage_bill(paid, "RED").collect()
    assert [(r.player_id, r.guaranteed_compensation) for r in bill] == [("p1", 210_000.0), ("p2", 70_000.0), ("p3", None)]
    assert len(plans.team_wage_bill(paid, "RED", n=1).collect()) == 1


def test_salary_vs_output(spark, paid):
    found = plans.salary_vs_output(player_goals_added(spark), paid, 2023).collect()
    assert [(r.player_id, r.team_id, r.salary) for r in found] == [
        ("p3", "t1", 1000.0),
        ("p1", "t2", 300.0),
        ("p1", "t1", 200.0),
        ("p2", "t1", 65.0),
        ("p9", "t9", 50.0),
    ]
    by = {(r.player_id, r.team_id): r for r in found}
    ann = by[("p1", "t1")]
    assert (ann.gadd_player, ann.gadd_team, ann.gaddplayer96) == (21.0, 18.0, 2.1)
    assert ann.m90s == pytest.approx(960 / 90)
    assert by[("p2", "t1")].gaddplayer96 is None  # no minutes
    assert by[("p3", "t1")].gadd_player is None  # no actions, still paid
    backs = plans.position_filter(plans.salary_vs_output(player_goals_added(spark), paid, 2023), "CB")
    assert {r.player_id for r in backs.collect()} == {"p1"}


def test_latest_release_before_or_after_the_join_is_the_same(spark, paid):
    output = player_goals_added(spark).filter("season_name = '2023'").select("player_id", "team_id", "minutes_played")
    after = op.keep_group_max(op.join_natural(output, paid, how="right"), ["player_id"], "mlspa_release")
    before = op.join_natural(output, op.keep_group_max(paid, ["player_id"], "mlspa_release"), how="right")
    assert rows(after) == rows(before)


def test_unnest_then_pivot_keeps_the_sum(spark):
    nested = player_goals_added(spark)
    long = op.unnest(nested, "data")
    wide = op.pivot_wider(long.drop("goals_added_above_avg", "count_actions"), "action_type", "goals_added_raw", ACTIONS)
    whole = wide.select(sum((F.coalesce(a, F.lit(0.0)) for a in ACTIONS), F.lit(0.0)).alias("x")).agg(F.sum("x"))
    assert whole.first()[0] == long.agg(F.sum("goals_added_raw")).first()[0]


def test_moments_skip_players_with_a_missing_action(spark):
    found = plans.goals_added_moments(player_goals_added(spark), 2023).first()
    values = [21.0, 6.0, 3.0]
    mean = sum(values) / 3
    assert found.mean_gadd_player == pytest.approx(mean)
    assert found.sd_gadd_player == pytest.approx((sum((v - mean) ** 2 for v in values) / 2) ** 0.5)
    strict = plans.goals_added_moments(player_goals_added(spark), 2023, nulls="propagate").first()
    assert strict.mean_gadd_player is None


def test_per_96_table(spark):
    where = (F.col("team_abbreviation") == "RED") | (
        (F.col("player_name") == "Ann") & (F.col("team_abbreviation") != "BLU")
    )
    found = plans.player_goals_added_p96(player_goals_added(spark), players(spark), teams(spark), 2023, where)
    assert found.columns == (
        ["player_name", "general_position", "minutes_played", *ACTIONS, "goals_added", "ga_team"]
        + [f"{c}_p96" for c in [*ACTIONS, "goals_added", "ga_team"]]
    )
    got = found.collect()
    assert [r.player_name for r in got] == ["Ann", "Bea"]
    assert got[0].goals_added_p96 == pytest.approx(2.1) and got[0].Passing_p96 == pytest.approx(0.4)
    assert got[1].goals_added_p96 is None


def test_goalkeepers_count_once_per_team(spark):
    args = (goalkeeper_goals_added(spark), players(spark), teams(spark), [2021, 2022, 2023])
    long = plans.goalkeeper_rows(*args)
    assert long.count() == 6
    found = plans.goalkeeper_goals_added(*args, where=(F.col("team_abbreviation") == "BLU") | (F.col("player_id") == "p1"))
    assert rows(found) == [("2022", "Bea", 2.5), ("2023", "Ann", 3.0)]
    plain = long.groupBy("season_name", "player_name").agg(F.sum("goals_added_raw").alias("goals_added_raw"))
    assert rows(plans.goalkeeper_goals_added(*args)) == rows(plain)
    strict = plans.goalkeeper_goals_added(*args, nulls="propagate")
    assert rows(strict) == [("2022", "Bea", 2.5), ("2023", "Ann", None)]


@pytest.fixture
def against(spark):
    return plans.zone_goals_against(
        team_goals_added(spark).filter("zone <= 30"), teams(spark), 2023
    )


def test_zones_select_and_unnest(spark):
    long = plans.team_zone_long(team_goals_added(spark))
    assert long.filter("zone = 31").count() == 6  # all zones unless some are asked for
    assert long.filter("zone <= 30").count() == 5 + 6 * 6
    assert plans.team_zone_long(team_goals_added(spark), [2]).select("zone").distinct().count() == 1


def test_absent_actions_are_zero_and_nulls_stay(spark, against):
    got = {(r.team_abbreviation, r.zone): r for r in against.collect()}
    assert got[("RED", 1)].Passing == 0.0 and got[("RED", 1)].team_goals_added_against == 4.0
    assert got[("BLU", 2)].Passing is None and got[("BLU", 2)].team_goals_added_against is None
    assert got[("RED", 2)].tgaa_96 == pytest.approx(0.6)
    assert "competitions" not in against.columns


def test_nested_and_long_zone_tables_agree(spark, against):
    long = plans.team_zone_long(team_goals_added(spark))
    assert set(OTHER_MEASURES) <= set(long.columns)
    by_long = plans.zone_goals_against(long, teams(spark), 2023).select(*against.columns)
    assert rows(by_long.filter("zone <= 30")) == rows(against)
    assert rows(by_long) == rows(plans.zone_goals_against(team_goals_added(spark), teams(spark), 2023))


def test_league_average_counts_rows_not_teams(against):
    doubled = against.unionByName(against.filter("team_abbreviation = 'BLU' AND zone = 1"))
    plain = {r.zone: r for r in plans.zone_league_average(doubled).collect()}
    assert plain[1].lg_avg_gaa == pytest.approx((4 + 8 + 8) / 3)
    differences = {(r.team_abbreviation, r.zone): r for r in plans.zone_zscores(doubled).collect()}
    assert differences[("RED", 1)].lg_avg_gaa == pytest.approx(plain[1].lg_avg_gaa)
    assert differences[("BLU", 1)].avg_gaa == 8.0


def test_z_scores_have_mean_zero_and_deviation_one(spark):
    made = [
        (f"t{t}", "2023", 900.0, [("Passing", 1, 0.1, 1, float((t * 7 + z * 3) % 11))], z)
        for t in range(8)
        for z in range(1, 6)
    ]
    nested = spark.createDataFrame(made, team_goals_added(spark).schema)
    sides = spark.createDataFrame([(f"t{t}", f"T{t}") for t in range(8)], "team_id string, team_abbreviation string")
    zones = plans.zone_goals_against(nested, sides, 2023)
    scores = plans.zone_zscores(zones)
    assert scores.count() == 40
    for r in scores.groupBy("zone").agg(F.avg("sd_above_mean").alias("m"), F.stddev_samp("sd_above_mean").alias("s")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)
    spread = {r.zone: r for r in plans.zone_spread(zones).collect()}
    one = plans.zone_zscores(zones, "T3").collect()
    assert len(one) == 5
    for r in one:
        assert r.sd_gaa == pytest.approx(spread[r.zone].sd_gaa)
        assert r.gvla_96 == pytest.approx(r.lg_avg_gaa_96 - r.avg_gaa_96)


def test_salary_bands(spark):
    points = spark.createDataFrame(
        [(64.9, 9.0), (65.0, 1.82), (299.9, 0.18), (300.0, 7.0), (1999.0, None), (2000.0, 1.0), (None, 1.0)],
        "salary double, gadd_player double",
    )
    labelled = plans.label_bands(points).collect()
    assert [r.salary_band for r in labelled] == [None, "low", "low", "middle", "high", None, None]
    assert [r.line_reached for r in labelled] == [6.78, 1.82, None, 6.78, None, None, None]
    banded = [("high", 1, None, None), ("low", 2, 1.0, 1.82), ("middle", 1, 7.0, 6.78), ("outside", 3, pytest.approx(11 / 3), 6.78)]
    assert rows(plans.salary_bands(points)) == banded
    with pytest.raises(ValueError):
        plans.label_bands(points, bands=[("a", 0, 10), ("b", 5, 20)])


def test_log_salary(spark):
    df = spark.createDataFrame([(1000.0,), (None,)], "salary double")
    assert [r.log10_salary for r in plans.log_salary(df).collect()] == [pytest.approx(3.0), None]
