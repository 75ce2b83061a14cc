import pytest
from pyspark.sql import functions as F

from courtside import operators as op
from courtside import plans
from fixtures import results, shots
from helpers import rows


@pytest.fixture
def clean(spark):
    return plans.clean_shots(shots(spark))


def test_clean_shots(clean):
    assert clean.columns == (
        "date squad home_away match_half minute player penalty xg psxg outcome shot_class distance body_part on_target "
        "country season_end_year match_url"
    ).split()
    found = [(r.player, r.penalty, r.xg, r.psxg, r.shot_class, r.on_target) for r in clean.collect()]
    assert found == [
        ("Ann", 0, 0.16, 0.2, "Above-Average Chance", "On-Target"),
        ("Ann", 0, 0.15, 0.15, "Average Chance", "On-Target"),
        ("Ann", 1, 0.79, 0.9, "Penalty", "On-Target"),
        ("Bea", 0, 0.08, 0.0, "Average Chance", "Off-Target"),
        ("Bea", 1, 0.03, 0.01, "Penalty", "On-Target"),
        ("Cid", 0, 0.02, 0.0, "Poor Chance", "On-Target"),
        ("Cid", 0, None, 0.0, "Poor Chance", "Off-Target"),
        ("Dot", 0, 0.5, 0.6, "Above-Average Chance", "On-Target"),
    ]


@pytest.mark.parametrize("tie", ["added", "subtracted", "separate"])
def test_class_shares_sum_to_one(clean, tie):
    known = clean.filter(F.col("xg").isNotNull())
    found = plans.shot_class_summary(known, tie).collect()
    assert sum(r.pct for r in found) == pytest.approx(1)
    assert sum(r.n for r in found) == 7
    for r in found:
        shares = [r.miss_target, r.subtr_value, r.added_value] + ([r.equal_value] if tie == "separate" else [])
        assert sum(shares) == pytest.approx(1)


def test_best_class_first_and_null_rule(clean):
    found = plans.shot_class_summary(clean).collect()
    assert [r.shot_class for r in found][0] == "Above-Average Chance"
    assert found[0].asDict() == {
        "shot_class": "Above-Average Chance",
        "n": 2,
        "pct": 0.25,
        "xg_min": 0.16,
        "xg_max": 0.5,
        "miss_target": 0.0,
        "subtr_value": 0.0,
        "added_value": 1.0,
    }
    strict = {r.shot_class: r.xg_min for r in plans.shot_class_summary(clean, nulls="propagate").collect()}
    assert strict["Poor Chance"] is None and strict["Penalty"] == 0.03


def test_distribution(clean):
    found = plans.xg_distribution(clean).collect()
    assert [r.xg for r in found] == [0.02, 0.03, 0.08, 0.15, 0.16, 0.5, 0.79, None]
    assert [r.cdf for r in found] == [i / 8 for i in range(1, 9)]
    by_xg = {r.xg: r for r in found}
    assert by_xg[0.15].shot_class == "Above-Average Chance"
    assert (by_xg[0.15].equal_value, by_xg[0.15].goal) == (1.0, 0)
    assert by_xg[None].shot_class == "Poor Chance"


def test_on_target_by_outcome_keeps_missing_outcomes_apart(clean):
    assert rows(plans.on_target_by_outcome(clean)) == [("Off-Target", 2), ("On-Target", 5), (None, 1)]


def test_season_averages(clean):
    found = {(r.country, r.season_end_year): r for r in plans.season_averages(clean).collect()}
    eng = found[("ENG", 2023)]
    assert (eng.goals_avg, eng.miss_target_avg, eng.subtr_value_avg, eng.added_value_avg) == (0.5, 0.25, 0.25, 0.5)
    assert len(found) == 3


def test_player_finishing(clean):
    found = plans.player_finishing(clean, min_shots=2).collect()
    ann = next(r for r in found if r.player == "Ann")
    assert ann.shots == 3 and ann.goals == 2
    assert ann.xg_sum == pytest.approx(1.10)
    assert ann.goals_avg == 1.5 and ann.added_value_avg == 1.5 and ann.miss_target_avg == 0.75
    assert ann.goals_diff == pytest.approx(0.9)
    assert ann.added_value_diff == 0.5
    assert ann.added_value_ppdiff == pytest.approx(2 / 3 - 0.5)
    assert {r.player for r in found} == {"Ann", "Cid"}
    assert [r.player for r in found] == ["Ann", "Cid"]


def test_points_are_in_percent_and_worst_first(clean):
    table = {r.player: r for r in plans.player_finishing(clean, min_shots=2).collect()}
    points = plans.player_finishing(clean, min_shots=2, as_points=True).collect()
    assert [r.player for r in points] == ["Cid", "Ann"]
    for r in points:
        assert r.added_value_ppdiff == pytest.approx(100 * table[r.player].added_value_ppdiff)
        assert r.off_target_diff == r.miss_target - r.miss_target_avg
        assert r.ot_ppdiff == pytest.approx(100 * (r.off_target_pct - r.miss_target_avg / r.shots))


@pytest.mark.parametrize(("as_points", "bar"), [(False, 25), (True, 15)])
def test_default_bar_for_shots_is_inclusive(spark, as_points, bar):
    counts = {"P14": 14, "P15": 15, "P24": 24, "P25": 25}
    made = [(p, "S", "ENG", 2023, "Goal", 0.1, 0.2) for p, n in counts.items() for _ in range(n)]
    schema = "player string, squad string, country string, season_end_year int, outcome string, xg double, psxg double"
    found = plans.player_finishing(spark.createDataFrame(made, schema), as_points=as_points)
    assert {r.player for r in found.collect()} == {p for p, n in counts.items() if n >= bar}


def test_unordered_has_the_same_rows(clean):
    for as_points in (False, True):
        a = plans.player_finishing(clean, 1, as_points)
        b = plans.player_finishing(clean, 1, as_points, ordered=False)
        assert rows(a) == rows(b)


def test_null_squads_and_seasons_stay_in_the_finishing_table(clean):
    found = plans.player_finishing(clean, 1)
    dot = found.filter("player = 'Dot'").first()
    assert dot.squad is None and dot.goals_avg == 1.0
    missing = clean.withColumn("country", F.when(F.col("country") == "ENG", "ENG"))
    assert plans.player_finishing(missing, 1).filter("goals_avg IS NULL").count() == 0


def test_propagated_nulls_reach_player_and_season(clean):
    found = {r.player: r for r in plans.player_finishing(clean, 1, nulls="propagate").collect()}
    assert found["Cid"].xg_sum is None
    assert found["Ann"].xg_sum == pytest.approx(1.10)


def test_model_label_and_residuals(spark):
    points = spark.createDataFrame(
        [("A", "S", 2021, 1.0, 0.0), ("A", "S", 2022, 3.0, 1.0), ("B", "T", 2021, 5.5, 2.0)],
        "player string, squad string, season_end_year int, goals_diff double, added_value_diff double",
    )
    model = plans.finishing_model(points).first()
    assert model.slope == pytest.approx(2.25)
    assert model.equation == "Equation: [goals above expected] = 0.917 + 2.25 * [good shots above expected]"
    assert model.r_squared_label == "R-squared = 0.996"
    fitted = plans.fitted_points(points).collect()
    assert sum(r.residual for r in fitted) == pytest.approx(0)
    shown = plans.highlight_player(points, "^A$").collect()
    assert [r.label for r in shown] == ["S - 2021", "S - 2022"]
    assert rows(plans.player_title(points, "A", "Striking")) == [("A", "A - Striking")]


def test_team_finishing(clean):
    found = plans.team_finishing(clean).collect()
    reds = next(r for r in found if r.squad == "Reds")
    assert (reds.shots, reds.goals) == (4, 2)
    assert reds.xgdiff == pytest.approx(2 - 1.18) and reds.psxgdiff == pytest.approx(2 - 1.25)
    diffs = [r.psxgdiff for r in found]
    assert diffs == sorted(diffs)


def test_single_league_reads_blank_as_off_target_and_keeps_null(spark):
    found = plans.clean_shots_single_league(shots(spark))
    got = [(r.xg, r.psxg, r.on_target) for r in found.collect()]
    assert got[3] == (0.08, 0.0, 0)
    assert got[5] == (0.02, 0.0, 0)
    assert got[6] == (None, None, None)
    assert got[0] == (0.16, 0.2, 1)
    assert rows(plans.distinct_seasons(found)) == [(2022,), (2023,)]


def test_two_sided_results_double_the_rows_and_balance(spark):
    found = plans.two_sided_results(results(spark))
    assert found.count() == 6
    total = found.agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga")).first()
    assert total.gf == total.ga == 9
    away = found.filter("team = 'Blues' AND home_away = 'Away'").first()
    assert (away.opponent, away.gf, away.ga) == ("Reds", 1, 2)


def test_shots_meet_every_match_of_their_squad_that_day(spark):
    league = plans.clean_shots_single_league(shots(spark))
    joined = plans.shots_with_opponent(league, plans.two_sided_results(results(spark)))
    assert joined.columns[:2] == ["match_url", "date"] and "home_away_r" in joined.columns
    found = rows(joined.groupBy("squad", "opponent").count())
    assert found == [("Blues", "Reds", 3), ("Reds", "Blues", 4), ("Reds", "Greens", 4), (None, None, 1)]


@pytest.mark.parametrize("nulls", ["skip", "propagate"])
def test_shots_allowed_equals_joining_every_shot(spark, nulls):
    """Summing before the join against the plain way."""
    from courtside.functions import count_true, scored, total

    league = plans.clean_shots_single_league(shots(spark))
    both = plans.two_sided_results(results(spark))
    plain = (
        plans.shots_with_opponent(league, both)
        .filter("season_end_year = 2023")
        .groupBy("season_end_year", "opponent")
        .agg(
            F.count("*"),
            total("on_target", nulls),
            count_true(scored(), nulls),
            F.round(total("xg", nulls), 6),
        )
    )
    allowed = plans.shots_allowed(league, both, 2023, totals=None, nulls=nulls)
    summed = allowed.select(
        "season_end_year", "opponent", "shots_allowed", "sot_allowed", "goals_allowed", F.round("xg_allowed", 6)
    )
    assert rows(summed) == rows(plain)


def test_shots_allowed_totals_row(spark):
    league = plans.clean_shots_single_league(shots(spark))
    both = plans.two_sided_results(results(spark))
    found = plans.shots_allowed(league, both, 2023).collect()
    total = next(r for r in found if r.season_end_year == "Total")
    teams = [r for r in found if r.season_end_year != "Total"]
    assert total.opponent == "-"
    for name in ("shots_allowed", "sot_allowed", "goals_allowed"):
        assert total[name] == sum(r[name] for r in teams)
    assert total.shot_pct == total.goals_allowed / total.shots_allowed
    assert total.sot_exp == pytest.approx(total.shots_allowed * 5505 / 16002)
    summed = plans.shots_allowed(league, both, 2023, totals="sum_all").collect()
    bottom = next(r for r in summed if r.season_end_year == "Total")
    assert bottom.shot_pct == pytest.approx(sum(r.shot_pct for r in teams))


def test_opponent_is_the_other_team(spark):
    stats = spark.createDataFrame(
        [(2023, "A", "A", "B"), (2023, "B", "A", "B"), (2022, "A", "A", "B"), (2023, None, "A", "B")],
        "season_end_year int, team string, home_team string, away_team string",
    )
    found = plans.team_match_opponent(stats, 2023)
    assert [(r.team, r.opponent) for r in found.collect()] == [("A", "B"), ("B", "A"), (None, None)]


def test_verbs_compose_on_raw_names(spark):
    assert op.clean_names(shots(spark)).columns[7:9] == ["x_g", "p_sx_g"]
