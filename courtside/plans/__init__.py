"""The queries users run: each takes DataFrames and parameters and returns a lazy DataFrame."""

from courtside.plans.goals_added import (
    goalkeeper_goals_added,
    goalkeeper_rows,
    goals_added_moments,
    log_salary,
    player_goals_added_p96,
    position_filter,
    salary_vs_output,
)
from courtside.plans.golf import adjusted_par, course_handicap
from courtside.plans.listing import category_counts, category_filter, post_listing
from courtside.plans.results import (
    expected_on_target,
    shots_allowed,
    shots_with_opponent,
    team_match_opponent,
    two_sided_results,
)
from courtside.plans.salaries import label_bands, salary_bands, season_salaries, team_wage_bill
from courtside.plans.shots import (
    clean_shots,
    clean_shots_single_league,
    distinct_seasons,
    finishing_model,
    fitted_points,
    highlight_player,
    on_target_by_outcome,
    player_finishing,
    player_title,
    season_averages,
    shot_class_summary,
    team_finishing,
    xg_distribution,
)
from courtside.plans.zones import (
    team_zone_long,
    zone_goals_against,
    zone_league_average,
    zone_spread,
    zone_zscores,
)

__all__ = [
    "adjusted_par",
    "category_counts",
    "category_filter",
    "clean_shots",
    "clean_shots_single_league",
    "course_handicap",
    "distinct_seasons",
    "expected_on_target",
    "finishing_model",
    "fitted_points",
    "goalkeeper_goals_added",
    "goalkeeper_rows",
    "goals_added_moments",
    "highlight_player",
    "label_bands",
    "log_salary",
    "on_target_by_outcome",
    "player_finishing",
    "player_goals_added_p96",
    "player_title",
    "position_filter",
    "post_listing",
    "salary_bands",
    "salary_vs_output",
    "season_averages",
    "season_salaries",
    "shot_class_summary",
    "shots_allowed",
    "shots_with_opponent",
    "team_finishing",
    "team_match_opponent",
    "team_wage_bill",
    "team_zone_long",
    "two_sided_results",
    "xg_distribution",
    "zone_goals_against",
    "zone_league_average",
    "zone_spread",
    "zone_zscores",
]
