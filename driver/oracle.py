"""The registered queries as SQL over the driver's tables, written independently of the library."""

from __future__ import annotations

SHOT_SEASON = 1998
SALARY_SEASON = 1998
ZONE_SEASON = 2024

# --- shared table expressions ---------------------------------------------------------------

SHOTS = """shots AS (
  SELECT 'match-' || l_orderkey AS match_url,
         CAST(l_shipdate AS DATE) AS date,
         'T' || (l_suppkey // 10) AS squad,
         CASE WHEN l_linenumber % 2 = 0 THEN 'Home' ELSE 'Away' END AS home_away,
         CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS match_half,
         CAST(l_quantity AS INTEGER) AS minute,
         'P' || l_suppkey AS player,
         CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS penalty,
         l_discount AS xg,
         l_tax AS psxg,
         CASE l_returnflag WHEN 'R' THEN 'Goal' WHEN 'A' THEN 'Saved' ELSE 'Off Target' END AS outcome,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS distance,
         CASE l_linenumber % 3 WHEN 0 THEN 'Head' WHEN 1 THEN 'Left Foot' ELSE 'Right Foot' END AS body_part,
         l_linestatus AS country,
         CAST(year(l_shipdate) AS INTEGER) AS season_end_year
  FROM lineitem
)"""

SHOT_CLASS = """CASE WHEN penalty = 1 THEN 'Penalty'
              WHEN xg >= 0.08 THEN 'Above-Average Chance'
              WHEN xg >= 0.05 THEN 'Average Chance'
              WHEN xg >= 0.03 THEN 'Below-Average Chance'
              ELSE 'Poor Chance' END"""

CLEAN = SHOTS + f""",
clean AS (
  SELECT *, {SHOT_CLASS} AS shot_class,
         CASE WHEN psxg = 0 THEN 'Off-Target' ELSE 'On-Target' END AS on_target
  FROM shots
)"""

# lineitem's xG and post-shot xG have two decimals; their sums are exact as decimals.
XG_SUM = "CAST(sum(CAST(xg AS DECIMAL(18,2))) AS DOUBLE)"
PSXG_SUM = "CAST(sum(CAST(psxg AS DECIMAL(18,2))) AS DOUBLE)"

MISSED = "count(*) FILTER (psxg = 0)"
LESS = "count(*) FILTER (psxg <> 0 AND psxg < xg)"
LESS_OR_SAME = "count(*) FILTER (psxg <> 0 AND psxg <= xg)"
SAME = "count(*) FILTER (psxg <> 0 AND psxg = xg)"
MORE = "count(*) FILTER (psxg <> 0 AND psxg > xg)"
MORE_OR_SAME = "count(*) FILTER (psxg <> 0 AND psxg >= xg)"
GOALS = "count(*) FILTER (outcome = 'Goal')"

AVERAGES = CLEAN + f""",
averages AS (
  SELECT country, season_end_year,
         {GOALS} / count(*) AS goals_rate,
         {MISSED} / count(*) AS miss_rate,
         {LESS_OR_SAME} / count(*) AS subtr_rate,
         {MORE} / count(*) AS added_rate
  FROM clean GROUP BY country, season_end_year
)"""


def _finishing(min_shots: int) -> str:
    return AVERAGES + f""",
players AS (
  SELECT player, squad, country, season_end_year, count(*) AS shots, {GOALS} AS goals, {XG_SUM} AS xg_sum,
         {MISSED} AS miss_target, {LESS_OR_SAME} AS subtr_value, {MORE} AS added_value
  FROM clean GROUP BY player, squad, country, season_end_year HAVING count(*) >= {min_shots}
),
joined AS (
  SELECT p.*,
         round_even(goals_rate * shots * 100, 0) / 100 AS goals_avg,
         round_even(miss_rate * shots * 100, 0) / 100 AS miss_target_avg,
         round_even(subtr_rate * shots * 100, 0) / 100 AS subtr_value_avg,
         round_even(added_rate * shots * 100, 0) / 100 AS added_value_avg
  FROM players p LEFT JOIN averages USING (country, season_end_year)
),
measured AS (
  SELECT *, round(goals - xg_sum, 2) AS goals_diff,
         added_value - added_value_avg AS added_value_diff,
         added_value / shots AS added_value_pct,
         added_value / shots - added_value_avg / shots AS ppdiff,
         miss_target - miss_target_avg AS off_target_diff,
         miss_target / shots AS off_target_pct,
         100 * (miss_target / shots - miss_target_avg / shots) AS ot_ppdiff
  FROM joined
)"""


POINTS = _finishing(15)

LINE = POINTS + """,
line AS (
  SELECT regr_intercept(goals_diff, added_value_diff) AS a, regr_slope(goals_diff, added_value_diff) AS b,
         regr_r2(goals_diff, added_value_diff) AS r2, count(*) AS n FROM measured
)"""

# A number with up to three decimals and no trailing zeros, as in the model's label.
SHORT = "regexp_replace(printf('%.3f', round_even({0}, 3)), '\\.?0+$', '')"

RESULTS = """matches AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_custkey // 150 AS h, o_orderkey // 1500 AS a,
         CAST(o_orderkey % 5 AS INTEGER) AS home_goals, CAST(o_custkey % 4 AS INTEGER) AS away_goals,
         CAST(year(o_orderdate) AS INTEGER) AS season_end_year
  FROM orders
),
results AS (
  SELECT date, 'T' || h AS home, 'T' || CASE WHEN a = h THEN h + 1 ELSE a END AS away,
         home_goals, away_goals, season_end_year
  FROM matches
),
two_sided AS (
  SELECT date, home AS team, away AS opponent, home_goals AS gf, away_goals AS ga, 'Home' AS home_away FROM results
  UNION ALL
  SELECT date, away, home, away_goals, home_goals, 'Away' FROM results
)"""

TEAMS = """teams AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS team_name, lower(n_name) AS team_short_name,
         'N' || n_nationkey AS team_abbreviation
  FROM nation
)"""

PLAYERS = """players AS (
  SELECT CAST(c_custkey AS VARCHAR) AS player_id, c_name AS player_name, 'NAT' || c_nationkey AS nationality
  FROM customer
)"""

ACTION = """CASE event_type WHEN 'error' THEN 'Interrupting' WHEN 'view' THEN 'Passing'
              WHEN 'purchase' THEN 'Receiving' WHEN 'signup' THEN 'Shooting'
              ELSE CASE WHEN event_id % 2 = 0 THEN 'Dribbling' ELSE 'Fouling' END END"""

# Long form: a row per player, season and action.
GA = f"""acts AS (
  SELECT *, {ACTION} AS action_type, 1995 + week(ts) AS season, CAST(value AS DECIMAL(18,2)) AS v FROM events
),
minutes AS (SELECT user_id, season, CAST(90 * count(*) AS DOUBLE) AS minutes_played FROM acts GROUP BY ALL),
ga AS (
  SELECT CAST(user_id AS VARCHAR) AS player_id, CAST(user_id % 25 AS VARCHAR) AS team_id,
         CAST(season AS VARCHAR) AS season_name,
         CASE user_id % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' WHEN 2 THEN 'CM' ELSE 'ST' END AS general_position,
         minutes_played, action_type, CAST(sum(v) AS DOUBLE) AS goals_added_raw,
         CAST(sum(v) - 20 * count(*) AS DOUBLE) AS goals_added_above_avg, count(*) AS count_actions
  FROM acts JOIN minutes USING (user_id, season)
  GROUP BY user_id, season, minutes_played, action_type
)"""

ACTIONS = ["Dribbling", "Fouling", "Interrupting", "Passing", "Receiving", "Shooting"]
ACTION_CELLS = ", ".join(f"max(goals_added_raw) FILTER (action_type = '{a}') AS {a}" for a in ACTIONS)

GA_WIDE = GA + f""",
wide AS (
  SELECT player_id, team_id, season_name, general_position, minutes_played, {ACTION_CELLS}
  FROM ga GROUP BY player_id, team_id, season_name, general_position, minutes_played
),
sums AS (SELECT *, {' + '.join(ACTIONS)} AS gadd_player FROM wide),
ga_wide AS (SELECT *, gadd_player - Interrupting AS gadd_team FROM sums)"""

GK = GA + """,
gk AS (
  SELECT player_id, team_id, season_name, minutes_played, action_type, goals_added_raw, goals_added_above_avg,
         count_actions FROM ga
  UNION ALL
  SELECT player_id, CAST((CAST(team_id AS INTEGER) + 7) % 25 AS VARCHAR), season_name, minutes_played, action_type,
         goals_added_raw, goals_added_above_avg, count_actions FROM ga
)"""

ZONES = f"""acts AS (
  SELECT *, {ACTION} AS action_type, user_id % 25 AS team, event_id % 30 + 1 AS zone, year(ts) AS season,
         CAST(value AS DECIMAL(18,2)) AS v
  FROM events
),
zone_minutes AS (SELECT team, zone, season, CAST(90 * count(*) AS DOUBLE) AS minutes FROM acts GROUP BY ALL),
zones AS (
  SELECT CAST(team AS VARCHAR) AS team_id, CAST(season AS VARCHAR) AS season_name, minutes,
         CAST(zone AS INTEGER) AS zone, action_type,
         count(*) FILTER (value > 20) AS num_actions_for,
         CAST(count(*) FILTER (value > 20) AS DOUBLE) / 10 AS goals_added_for,
         count(*) AS num_actions_against, CAST(sum(v) AS DOUBLE) AS goals_added_against
  FROM acts JOIN zone_minutes USING (team, zone, season)
  GROUP BY team, zone, season, minutes, action_type
)"""

AGAINST_ACTIONS = ["Fouling", "Receiving", "Passing", "Dribbling", "Shooting"]
AGAINST_CELLS = ", ".join(
    f"CASE WHEN count(*) FILTER (action_type = '{a}') = 0 THEN 0.0e0 "
    f"ELSE max(goals_added_against) FILTER (action_type = '{a}') END AS {a}"
    for a in AGAINST_ACTIONS
)

AGAINST = ZONES + f""",
{TEAMS},
zone_wide AS (
  SELECT team_id, season_name, minutes, zone, {AGAINST_CELLS} FROM zones
  WHERE season_name = '{ZONE_SEASON}' GROUP BY team_id, season_name, minutes, zone
),
zone_sums AS (SELECT *, {' + '.join(AGAINST_ACTIONS)} AS team_goals_added_against FROM zone_wide),
against AS (
  SELECT z.*, team_name, team_short_name, team_abbreviation, 96 * team_goals_added_against / NULLIF(minutes, 0) AS tgaa_96
  FROM zone_sums z LEFT JOIN teams USING (team_id)
)"""

DIFFERENCES = AGAINST + """,
league AS (
  SELECT zone, avg(tgaa_96) AS lg_avg_gaa_96, avg(team_goals_added_against) AS lg_avg_gaa FROM against GROUP BY zone
),
team AS (
  SELECT team_abbreviation, zone, avg(tgaa_96) AS avg_gaa_96, avg(team_goals_added_against) AS avg_gaa
  FROM against GROUP BY team_abbreviation, zone
),
differences AS (
  SELECT *, lg_avg_gaa - avg_gaa AS gaa_vs_lg_avg, lg_avg_gaa_96 - avg_gaa_96 AS gvla_96
  FROM team LEFT JOIN league USING (zone)
),
spread AS (
  SELECT zone, avg(gaa_vs_lg_avg) AS mean_gaa, stddev_samp(gaa_vs_lg_avg) AS sd_gaa FROM differences GROUP BY zone
)"""

SALARIES = """salaries AS (
  SELECT CAST(o_custkey AS VARCHAR) AS player_id, CAST(o_custkey % 25 AS VARCHAR) AS team_id,
         CAST(year(o_orderdate) AS INTEGER) AS season_name, o_totalprice AS base_salary,
         o_totalprice * CAST(1.1 AS DOUBLE) AS guaranteed_compensation, CAST(o_orderdate AS DATE) AS mlspa_release
  FROM orders
)"""

PAID = f"""{SALARIES}, {PLAYERS}, {TEAMS},
paid AS (
  SELECT s.*, player_name, nationality, team_name, team_short_name, team_abbreviation
  FROM salaries s LEFT JOIN players USING (player_id) LEFT JOIN teams USING (team_id)
  WHERE season_name = {SALARY_SEASON}
)"""

OUTPUT = GA_WIDE + f""",
{PAID},
latest AS (SELECT * FROM paid QUALIFY mlspa_release = max(mlspa_release) OVER (PARTITION BY player_id)),
output AS (
  SELECT l.player_id, l.team_id, l.season_name, general_position, minutes_played, {', '.join(ACTIONS)},
         gadd_player, gadd_team, 96 * gadd_player / NULLIF(minutes_played, 0) AS gaddplayer96,
         base_salary, guaranteed_compensation, mlspa_release, player_name, nationality, team_name, team_short_name,
         team_abbreviation, base_salary / 1000 AS salary, minutes_played / 90 AS m90s
  FROM ga_wide g RIGHT JOIN latest l
    ON g.player_id = l.player_id AND g.team_id = l.team_id AND CAST(g.season_name AS INTEGER) = l.season_name
)"""

POSTS = """posts AS (
  SELECT 'doc-' || doc_id AS title, source AS author, DATE '2000-01-01' + CAST(n_chars AS INTEGER) AS date,
         [lang, source] AS categories
  FROM documents
)"""

P96 = ", ".join(
    f"96 * {c} / NULLIF(minutes_played, 0) AS {c}_p96" for c in [*ACTIONS, "goals_added", "ga_team"]
)

GAP_SHOTS = f"""{SHOTS}, gaps AS (
  SELECT date, CASE WHEN minute % 13 <> 0 THEN squad END AS squad,
         CASE WHEN NOT (minute % 11 = 0 AND squad <> 'T1') THEN xg END AS xg,
         CASE WHEN minute % 7 <> 0 THEN outcome END AS outcome
  FROM shots
)"""

GAP_AGAINST = ZONES + f""",
{TEAMS},
gap_zones AS (
  SELECT * REPLACE (
    CASE WHEN zone % 5 <> 0 OR team_id <> '3' THEN minutes END AS minutes,
    CASE WHEN NOT (zone % 7 = 0 AND team_id = '4' AND action_type = 'Passing') THEN goals_added_against END AS goals_added_against)
  FROM zones
),
zone_wide AS (
  SELECT team_id, season_name, minutes, zone, {AGAINST_CELLS} FROM gap_zones
  WHERE season_name = '{ZONE_SEASON}' GROUP BY team_id, season_name, minutes, zone
),
zone_sums AS (SELECT *, {' + '.join(AGAINST_ACTIONS)} AS raw FROM zone_wide),
against AS (
  SELECT zone, team_abbreviation, raw, 96 * raw / NULLIF(minutes, 0) AS rate FROM zone_sums LEFT JOIN teams USING (team_id)
),
league AS (
  SELECT zone, CASE WHEN count(rate) = count(*) THEN avg(rate) END AS lg_avg_gaa_96, CASE WHEN count(raw) = count(*) THEN avg(raw) END AS lg_avg_gaa
  FROM against GROUP BY zone
),
team AS (
  SELECT team_abbreviation, zone, CASE WHEN count(rate) = count(*) THEN avg(rate) END AS avg_gaa_96,
         CASE WHEN count(raw) = count(*) THEN avg(raw) END AS avg_gaa
  FROM against GROUP BY team_abbreviation, zone
),
differences AS (
  SELECT *, lg_avg_gaa - avg_gaa AS gaa_vs_lg_avg, lg_avg_gaa_96 - avg_gaa_96 AS gvla_96 FROM team LEFT JOIN league USING (zone)
),
spread AS (
  SELECT zone, CASE WHEN count(gaa_vs_lg_avg) = count(*) THEN avg(gaa_vs_lg_avg) END AS mean_gaa,
         CASE WHEN count(gaa_vs_lg_avg) = count(*) THEN stddev_samp(gaa_vs_lg_avg) END AS sd_gaa
  FROM differences GROUP BY zone
)"""

# Student's quantile for 95 % from the normal one, for many degrees of freedom.
T95 = "(z + (z^3 + z) / (4 * f) + (5 * z^5 + 16 * z^3 + 3 * z) / (96 * f^2) + (3 * z^7 + 19 * z^5 + 17 * z^3 - 15 * z) / (384 * f^3))"

# --- one statement per query ----------------------------------------------------------------

ORACLE: dict[str, str] = {
    "select_rename": f"WITH {RESULTS} SELECT CAST(date AS VARCHAR) AS match_day, home AS team, away AS opponent FROM results",
    "drop_cols": f"WITH {PLAYERS} SELECT player_id, player_name FROM players",
    "positional_select": "SELECT c_acctbal, c_name, c_nationkey FROM customer",
    "across_rates": f"""WITH {CLEAN}, s AS (
        SELECT player, season_end_year, count(*) AS shots, {MISSED} AS m, {LESS} AS l, {SAME} AS e, {MORE} AS a
        FROM clean GROUP BY player, season_end_year)
      SELECT player, season_end_year, shots, m / shots AS miss_target, l / shots AS subtr_value,
             e / shots AS equal_value, a / shots AS added_value, 96 * m / shots AS miss_target_p96,
             96 * l / shots AS subtr_value_p96, 96 * e / shots AS equal_value_p96, 96 * a / shots AS added_value_p96
      FROM s""",
    "separate_penalty": f"WITH {SHOTS} SELECT match_url, minute, player, penalty FROM shots",
    "try_numeric": f"""WITH {SHOTS} SELECT match_url, xg, NULLIF(psxg, 0) AS psxg, psxg AS psxg_filled,
        minute AS distance FROM shots""",
    "filter_or_and": f"""WITH {SHOTS} SELECT match_url, player, squad, country, season_end_year, xg FROM shots
        WHERE (squad = 'T0' OR player = 'P12' AND country <> 'O') AND season_end_year IN (1997, 1998, 1999)""",
    "having_min_shots": f"""WITH {SHOTS} SELECT player, squad, country, season_end_year, count(*) AS shots FROM shots
        GROUP BY ALL HAVING count(*) >= 40""",
    "latest_release": f"""WITH {SALARIES} SELECT player_id, CAST(mlspa_release AS VARCHAR) AS mlspa_release, base_salary
        FROM salaries QUALIFY salaries.mlspa_release = max(salaries.mlspa_release) OVER (PARTITION BY player_id)""",
    "name_match": f"WITH {PLAYERS} SELECT * FROM players WHERE regexp_matches(player_name, '0[1-3]7$')",
    "left_natural": f"""WITH {SALARIES}, {PLAYERS} SELECT player_id, base_salary, player_name
        FROM salaries LEFT JOIN players USING (player_id)""",
    "left_null_keys": """WITH l AS (SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders),
        r AS (SELECT priority, count(*) AS n FROM l GROUP BY priority)
      SELECT o_orderkey, coalesce(l.priority, 'NA') AS priority, n
      FROM l LEFT JOIN r ON l.priority IS NOT DISTINCT FROM r.priority""",
    "left_composite": f"""WITH {SHOTS}, {RESULTS} SELECT match_url, CAST(s.date AS VARCHAR) AS date, squad, xg,
        coalesce(opponent, 'NA') AS opponent, gf
      FROM shots s LEFT JOIN two_sided r ON s.date = r.date AND s.squad = r.team""",
    "right_keep_all": f"""WITH {PLAYERS}, m AS (
        SELECT CAST(user_id AS VARCHAR) AS player_id, CAST(90 * count(*) AS DOUBLE) AS minutes FROM events GROUP BY user_id)
      SELECT p.player_id, minutes, player_name FROM m RIGHT JOIN players p ON m.player_id = p.player_id""",
    "outcome_counts": f"""WITH {SHOTS} SELECT squad, season_end_year, count(*) AS shots, {XG_SUM} AS xg_sum, {GOALS} AS goals,
        {MISSED} AS miss_target, {LESS} AS subtr_value, {SAME} AS equal_value, {MORE} AS added_value
      FROM shots GROUP BY squad, season_end_year""",
    "mean_sd_by_key": """SELECT CAST(year(o_orderdate) AS INTEGER) AS season, round(avg(o_totalprice), 6) AS mean_price,
        round(stddev_samp(o_totalprice), 6) AS sd_price FROM orders GROUP BY 1""",
    "min_max": f"WITH {CLEAN} SELECT shot_class, min(xg) AS xg_min, max(xg) AS xg_max FROM clean GROUP BY shot_class",
    "totals_row": f"""WITH {SHOTS}, c AS (
        SELECT season_end_year, country, count(*) AS shots, {GOALS} AS goals FROM shots GROUP BY ALL)
      SELECT CAST(season_end_year AS VARCHAR) AS season_end_year, country, shots, goals, goals / shots AS goal_pct FROM c
      UNION ALL
      SELECT 'Total', '-', CAST(sum(shots) AS BIGINT), CAST(sum(goals) AS BIGINT), sum(goals) / sum(shots) FROM c""",
    "expected_sot": f"""WITH {SHOTS}, c AS (
        SELECT squad, count(*) AS shots, count(*) FILTER (psxg <> 0) AS sot FROM shots GROUP BY squad)
      SELECT *, shots * 5505 / 16002 AS sot_exp, sot - shots * 5505 / 16002 AS sot_res FROM c""",
    "distinct_seasons": "SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS season_end_year FROM lineitem",
    "xg_cdf": """SELECT l_discount AS xg, count(*) AS n,
        sum(count(*)) OVER (ORDER BY l_discount) / sum(count(*)) OVER () AS cdf FROM lineitem GROUP BY l_discount""",
    "share_of_total": """SELECT 'P' || l_suppkey AS player, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct
      FROM lineitem GROUP BY l_suppkey""",
    "dev_from_group": f"""WITH {SHOTS}, m AS (
        SELECT squad, avg(xg) AS squad_mean FROM shots GROUP BY squad)
      SELECT match_url, minute, squad, xg, round(squad_mean, 6) AS squad_mean, round(squad_mean - xg, 6) AS dev
      FROM shots JOIN m USING (squad)""",
    "group_zscore": f"""WITH {AGAINST} SELECT team_abbreviation, zone,
        round(team_goals_added_against, 6) AS team_goals_added_against,
        round(avg(team_goals_added_against) OVER w, 6) AS zone_mean,
        round(stddev_samp(team_goals_added_against) OVER w, 6) AS zone_sd,
        round((against.team_goals_added_against - avg(against.team_goals_added_against) OVER w)
              / NULLIF(stddev_samp(against.team_goals_added_against) OVER w, 0), 6) AS z
      FROM against WINDOW w AS (PARTITION BY zone)""",
    "sorted_topk": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "union_by_name": f"""WITH {RESULTS} SELECT home AS team, home_goals AS gf, season_end_year FROM results
      UNION ALL SELECT away, -1, season_end_year FROM results""",
    "unnest_actions": f"WITH {GA} SELECT * FROM ga",
    "explode_teams": f"""WITH {GK} SELECT DISTINCT player_id, team_id, season_name, minutes_played FROM gk""",
    "pivot_actions": f"""WITH {GA_WIDE} SELECT * FROM wide""",
    "pivot_fill": f"""WITH {ZONES} SELECT team_id, season_name, minutes, zone, {AGAINST_CELLS} FROM zones
      GROUP BY team_id, season_name, minutes, zone""",
    "two_sided": f"WITH {RESULTS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM two_sided",
    "ols": """SELECT round(regr_intercept(o_totalprice, o_custkey), 6) AS intercept,
        round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_r2(o_totalprice, o_custkey), 6) AS r_squared,
        count(*) AS n FROM orders""",
    "ols_residuals": """WITH m AS (SELECT regr_intercept(o_totalprice, o_custkey) AS a,
        regr_slope(o_totalprice, o_custkey) AS b FROM orders)
      SELECT o_orderkey, o_custkey, o_totalprice, round(a + b * o_custkey, 2) AS fitted,
        round(o_totalprice - (a + b * o_custkey), 2) AS residual FROM orders, m""",
    "per96": f"""WITH {ZONES} SELECT team_id, zone, action_type,
        96 * goals_added_against / NULLIF(minutes, 0) AS against_p96, minutes / 90 AS m90s FROM zones""",
    "half_even_round": """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_quantity,
        round_even(l_extendedprice * l_discount * 100, 0) / 100 AS discount FROM lineitem""",
    "label_concat": f"""WITH {SHOTS} SELECT match_url,
        player || CASE WHEN penalty = 1 THEN ' (pen)' ELSE '' END || '(' || coalesce(CAST(NULLIF(psxg, 0) AS VARCHAR), 'NA')
          || ')' AS with_psxg,
        squad || ' - ' || season_end_year AS label FROM shots""",
    "log10_salary": f"""WITH {SALARIES} SELECT player_id, base_salary / 1000 AS salary,
        round(log10(base_salary / 1000), 6) AS log10_salary FROM salaries""",
    "clock_time": """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT)
        - 3600 * CASE o_orderkey % 4 WHEN 0 THEN 9 WHEN 1 THEN -5 WHEN 2 THEN -4 ELSE 2 END AS seconds FROM orders""",
    "clean_shots": f"""WITH {CLEAN} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM clean""",
    "shot_class_summary": f"""WITH {CLEAN} SELECT shot_class, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct,
        min(xg) AS xg_min, max(xg) AS xg_max, {MISSED} / count(*) AS miss_target, {LESS} / count(*) AS subtr_value,
        {MORE_OR_SAME} / count(*) AS added_value FROM clean GROUP BY shot_class""",
    "xg_distribution": f"""WITH {CLEAN}, d AS (
        SELECT xg, count(*) AS n, {MISSED} / count(*) AS miss_target, {LESS} / count(*) AS subtr_value,
               {SAME} / count(*) AS equal_value, {MORE} / count(*) AS added_value, {GOALS} AS goal
        FROM clean GROUP BY xg)
      SELECT *, sum(n) OVER (ORDER BY xg) / sum(n) OVER () AS cdf,
        CASE WHEN xg >= 0.08 THEN 'Above-Average Chance' WHEN xg >= 0.05 THEN 'Average Chance'
             WHEN xg >= 0.03 THEN 'Below-Average Chance' ELSE 'Poor Chance' END AS shot_class
      FROM d""",
    "on_target_by_outcome": f"""WITH {SHOTS} SELECT
        CASE WHEN outcome IN ('Goal', 'Saved') THEN 'On-Target' ELSE 'Off-Target' END AS on_target, count(*) AS n
      FROM shots GROUP BY 1""",
    "season_averages": f"""WITH {AVERAGES} SELECT country, season_end_year, goals_rate AS goals_avg,
        miss_rate AS miss_target_avg, subtr_rate AS subtr_value_avg, added_rate AS added_value_avg FROM averages""",
    "player_finishing": f"""WITH {_finishing(25)} SELECT player, squad, country, season_end_year, shots, goals, xg_sum,
        miss_target, subtr_value, added_value, goals_avg, miss_target_avg, subtr_value_avg, added_value_avg,
        goals_diff, added_value_diff, added_value_pct, ppdiff AS added_value_ppdiff FROM measured""",
    "player_finishing_points": f"""WITH {POINTS} SELECT player, squad, country, season_end_year, shots, goals, xg_sum,
        miss_target, subtr_value, added_value, goals_avg, miss_target_avg, subtr_value_avg, added_value_avg,
        goals_diff, added_value_diff, added_value_pct, off_target_diff, off_target_pct, ot_ppdiff,
        100 * ppdiff AS added_value_ppdiff FROM measured""",
    "finishing_model": f"""WITH {LINE} SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(r2, 6) AS r_squared, n,
        'Equation: [goals above expected] = ' || {SHORT.format('a')} || ' + ' || {SHORT.format('b')}
          || ' * [good shots above expected]' AS equation,
        'R-squared = ' || {SHORT.format('r2')} AS r_squared_label FROM line""",
    "fitted_points": f"""WITH {LINE} SELECT player, squad, country, season_end_year, goals_diff, added_value_diff,
        round(a + b * added_value_diff, 6) AS fitted, round(measured.goals_diff - (a + b * added_value_diff), 6) AS residual
      FROM measured, line""",
    "highlight_player": f"""WITH {POINTS} SELECT player, squad || ' - ' || season_end_year AS label, shots, goals_diff
      FROM measured WHERE regexp_matches(player, '^P[1-3]$')""",
    "player_title": f"""WITH {POINTS} SELECT DISTINCT player, player || ' - Against Expectation' AS title
      FROM measured WHERE regexp_matches(player, '^P[1-3]$')""",
    "team_finishing": f"""WITH {SHOTS}, t AS (
        SELECT country, squad, count(*) AS shots, {GOALS} AS goals, {XG_SUM} AS xg, {PSXG_SUM} AS psxg
        FROM shots GROUP BY country, squad)
      SELECT *, round(goals - xg, 2) AS xgdiff, round(goals - psxg, 2) AS psxgdiff FROM t""",
    "clean_shots_single_league": f"""WITH {SHOTS} SELECT match_url, CAST(date AS VARCHAR) AS date, squad,
        player || CASE WHEN penalty = 1 THEN ' (pen)' ELSE '' END AS player, xg, psxg,
        CASE WHEN psxg = 0 THEN 0 ELSE 1 END AS on_target, season_end_year FROM shots""",
    "two_sided_results": f"WITH {RESULTS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM two_sided",
    "shots_with_opponent": f"""WITH {SHOTS}, {RESULTS} SELECT match_url, CAST(s.date AS VARCHAR) AS date, squad,
        s.home_away, xg, CASE WHEN psxg = 0 THEN 0 ELSE 1 END AS on_target, coalesce(opponent, 'NA') AS opponent,
        coalesce(gf, -1) AS gf, coalesce(ga, -1) AS ga, coalesce(r.home_away, 'NA') AS home_away_r
      FROM shots s LEFT JOIN two_sided r ON s.date = r.date AND s.squad = r.team""",
    "shots_allowed": f"""WITH {SHOTS}, {RESULTS}, j AS (
        SELECT season_end_year, opponent, xg, outcome, psxg
        FROM shots s LEFT JOIN two_sided r ON s.date = r.date AND s.squad = r.team),
      g AS (
        SELECT CAST(season_end_year AS VARCHAR) AS season_end_year, coalesce(opponent, 'NA') AS opponent,
               count(*) AS shots_allowed, count(*) FILTER (psxg <> 0) AS sot_allowed, {GOALS} AS goals_allowed,
               {XG_SUM} AS xg_allowed
        FROM j WHERE j.season_end_year = {SHOT_SEASON} GROUP BY ALL),
      t AS (SELECT * FROM g UNION ALL
        SELECT 'Total', '-', CAST(sum(shots_allowed) AS BIGINT), CAST(sum(sot_allowed) AS BIGINT),
               CAST(sum(goals_allowed) AS BIGINT), CAST(sum(CAST(xg_allowed AS DECIMAL(18,2))) AS DOUBLE) FROM g)
      SELECT *, goals_allowed / shots_allowed AS shot_pct, sot_allowed / shots_allowed AS sot_pct,
        goals_allowed / NULLIF(sot_allowed, 0) AS gl_sot_pct, round(shots_allowed * 5505 / 16002, 6) AS sot_exp,
        round(sot_allowed - shots_allowed * 5505 / 16002, 6) AS sot_res FROM t""",
    "season_salaries": f"WITH {PAID} SELECT * REPLACE (CAST(mlspa_release AS VARCHAR) AS mlspa_release) FROM paid",
    "team_wage_bill": f"""WITH {PAID}, top AS (
        SELECT * FROM paid WHERE team_abbreviation = 'N3'
        QUALIFY mlspa_release = max(mlspa_release) OVER (PARTITION BY player_id)
        ORDER BY guaranteed_compensation DESC, player_id)
      SELECT player_id, player_name, CAST(mlspa_release AS VARCHAR) AS mlspa_release, guaranteed_compensation FROM top""",
    "salary_vs_output": f"""WITH {OUTPUT} SELECT * REPLACE (CAST(mlspa_release AS VARCHAR) AS mlspa_release,
        coalesce(general_position, 'NA') AS general_position) FROM output""",
    "goals_added_moments": f"""WITH {GA_WIDE} SELECT round(avg(gadd_player), 8) AS mean_gadd_player,
        round(stddev_samp(gadd_player), 8) AS sd_gadd_player FROM ga_wide WHERE season_name = '{SALARY_SEASON}'""",
    "goalkeeper_rows": f"""WITH {GK}, {PLAYERS}, {TEAMS} SELECT gk.*, player_name, nationality, team_name, team_short_name,
        team_abbreviation FROM gk LEFT JOIN players USING (player_id) LEFT JOIN teams USING (team_id)
      WHERE season_name IN ('1996', '1997', '1998')""",
    "goalkeeper_goals_added": f"""WITH {GK}, {PLAYERS}, {TEAMS} SELECT season_name, player_name,
        CAST(sum(CAST(goals_added_raw AS DECIMAL(18,2))) AS DOUBLE) AS goals_added_raw
      FROM gk LEFT JOIN players USING (player_id) LEFT JOIN teams USING (team_id)
      WHERE season_name IN ('1996', '1997', '1998') AND (team_abbreviation = 'N4' OR player_id = '7')
      GROUP BY season_name, player_name""",
    "position_filter": f"""WITH {OUTPUT} SELECT player_id, player_name, salary, m90s, gadd_player FROM output
      WHERE general_position = 'CB'""",
    "team_match_opponent": f"""WITH {RESULTS}, s AS (
        SELECT season_end_year, home AS team, home AS home_team, away AS away_team FROM results
        UNION ALL SELECT season_end_year, away, home, away FROM results)
      SELECT *, CASE WHEN team = home_team THEN away_team ELSE home_team END AS opponent FROM s
      WHERE season_end_year = {SHOT_SEASON}""",
    "player_goals_added_p96": f"""WITH {GA_WIDE}, {PLAYERS}, {TEAMS}, r AS (
        SELECT player_name, general_position, minutes_played, {', '.join(ACTIONS)}, gadd_player AS goals_added,
               gadd_team AS ga_team
        FROM ga_wide LEFT JOIN players USING (player_id) LEFT JOIN teams USING (team_id)
        WHERE season_name = '{SALARY_SEASON}'
          AND (team_abbreviation = 'N3' OR player_name = 'Customer#000000008' AND team_abbreviation <> 'N5'))
      SELECT *, {P96} FROM r""",
    "team_zone_long": f"WITH {ZONES} SELECT * FROM zones",
    "zone_goals_against": f"WITH {AGAINST} SELECT * FROM against",
    "zone_league_average": f"""WITH {DIFFERENCES} SELECT zone, round(lg_avg_gaa_96, 6) AS lg_avg_gaa_96,
        round(lg_avg_gaa, 6) AS lg_avg_gaa FROM league""",
    "zone_spread": f"""WITH {DIFFERENCES} SELECT zone, round(mean_gaa, 6) + 0.0e0 AS mean_gaa, round(sd_gaa, 6) AS sd_gaa FROM spread""",
    "zone_zscores": f"""WITH {DIFFERENCES} SELECT team_abbreviation, zone, round(avg_gaa_96, 6) AS avg_gaa_96,
        round(avg_gaa, 6) AS avg_gaa, round(lg_avg_gaa_96, 6) AS lg_avg_gaa_96, round(lg_avg_gaa, 6) AS lg_avg_gaa,
        round(gaa_vs_lg_avg, 6) + 0.0e0 AS gaa_vs_lg_avg, round(gvla_96, 6) AS gvla_96,
        round(mean_gaa, 6) + 0.0e0 AS mean_gaa, round(sd_gaa, 6) AS sd_gaa,
        round((differences.gaa_vs_lg_avg - spread.mean_gaa) / NULLIF(spread.sd_gaa, 0), 6) AS sd_above_mean
      FROM differences LEFT JOIN spread USING (zone)""",
    "course_handicap": """WITH par AS (
        SELECT l_orderkey AS round_id, CAST(sum(3 + l_linenumber % 3) AS BIGINT) AS par, count(*) AS holes FROM lineitem GROUP BY 1),
      rounds AS (
        SELECT o_orderkey AS round_id, CAST(113 + o_orderkey % 30 AS INTEGER) AS slope,
               CAST(68 + o_custkey % 8 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS rating, CAST(o_orderkey % 4 AS INTEGER) AS pc_coeff,
               CAST(o_custkey % 37 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS handicap_index FROM orders),
      a AS (
        SELECT rounds.*, par, holes, CAST(round_even(handicap_index * slope / 113 + rating, 0) + pc_coeff AS INTEGER) AS adjusted_par
        FROM rounds LEFT JOIN par USING (round_id))
      SELECT *, adjusted_par - par AS course_handicap FROM a""",
    "salary_bands": f"""WITH {OUTPUT} SELECT coalesce(salary_band, 'outside') AS salary_band, count(*) AS players, round(avg(gadd_player), 8) AS mean_output,
        max(CASE WHEN gadd_player >= 600 THEN 600.0e0 WHEN gadd_player >= 200 THEN 200.0e0
                 WHEN gadd_player >= 50 THEN 50.0e0 END) AS line_reached
      FROM output LEFT JOIN (VALUES ('low', 65, 300), ('middle', 300, 1000), ('high', 1000, 2000)) b(salary_band, low, high)
        ON salary >= low AND salary < high
      GROUP BY 1""",
    "post_listing": f"""WITH {POSTS} SELECT title, author, CAST(date AS VARCHAR) AS date,
        array_to_string(categories, ',') AS categories FROM posts""",
    "category_counts": f"""WITH {POSTS}, c AS (SELECT title, unnest(list_distinct(categories)) AS category FROM posts)
      SELECT category, count(*) AS n FROM c GROUP BY category UNION ALL SELECT 'All', count(*) FROM posts""",
    "category_filter": f"WITH {POSTS} SELECT title, author FROM posts WHERE list_contains(categories, 'fr')",
    "latest_release_gaps": f"""WITH {SALARIES}, g AS (
        SELECT player_id, CASE WHEN base_salary > 30000 THEN mlspa_release END AS mlspa_release, base_salary FROM salaries),
      m AS (SELECT player_id, max(mlspa_release) AS top FROM g GROUP BY player_id HAVING count(mlspa_release) = count(*))
      SELECT player_id, CAST(mlspa_release AS VARCHAR) AS mlspa_release, base_salary FROM g JOIN m USING (player_id) WHERE mlspa_release = top""",
    "latest_release_many_ties": f"""WITH {SALARIES} SELECT player_id, season_name, base_salary FROM salaries
        QUALIFY season_name = max(season_name) OVER (PARTITION BY player_id)""",
    "price_cdf": """SELECT o_totalprice, count(*) AS n, sum(count(*)) OVER (ORDER BY o_totalprice) / sum(count(*)) OVER () AS cdf
      FROM orders GROUP BY o_totalprice""",
    "fit_band": f"""WITH s AS (SELECT regr_intercept(o_totalprice, o_custkey) AS a, regr_slope(o_totalprice, o_custkey) AS b,
        count(*) AS n, avg(o_custkey) AS m, regr_sxx(o_totalprice, o_custkey) AS sxx FROM orders),
      r AS (SELECT sum((o_totalprice - a - b * o_custkey) ^ 2) AS sse FROM orders, s),
      t AS (SELECT *, {T95} * sqrt(sse / f) AS reach FROM (SELECT *, CAST(n - 2 AS DOUBLE) AS f, 1.959963984540054e0 AS z FROM s, r))
      SELECT o_orderkey, o_custkey, o_totalprice, round(a + b * o_custkey, 2) AS fitted,
        round(a + b * o_custkey - reach * sqrt(1.0e0 / n + (o_custkey - m) ^ 2 / sxx), 2) AS lower,
        round(a + b * o_custkey + reach * sqrt(1.0e0 / n + (o_custkey - m) ^ 2 / sxx), 2) AS upper FROM orders, t""",
    "totals_row_sum_all": f"""WITH {SHOTS}, c AS (
        SELECT season_end_year, country, count(*) AS shots, {GOALS} AS goals, {GOALS} / count(*) AS pct FROM shots GROUP BY ALL)
      SELECT CAST(season_end_year AS VARCHAR) AS season_end_year, country, shots, goals, round(pct, 8) AS goal_pct FROM c
      UNION ALL
      SELECT 'Total', '-', CAST(sum(shots) AS BIGINT), CAST(sum(goals) AS BIGINT), round(sum(pct), 8) FROM c""",
    "grouped_totals": f"""WITH {SHOTS}
      SELECT CAST(season_end_year AS VARCHAR) AS season_end_year, country, count(*) AS shots, {GOALS} AS goals, min(xg) AS xg_min,
        {GOALS} / count(*) AS goal_pct FROM shots GROUP BY ALL
      UNION ALL
      SELECT 'Total', '-', count(*), {GOALS}, min(xg), {GOALS} / count(*) FROM shots""",
    "pivot_doubled": f"""WITH {GA_WIDE} SELECT player_id, team_id, season_name, general_position, minutes_played,
        {', '.join(f'2 * {a} AS {a}' for a in ACTIONS)} FROM wide""",
    "left_unique": f"""WITH {SALARIES}, {PLAYERS} SELECT player_id, base_salary, player_name
        FROM salaries LEFT JOIN players USING (player_id)""",
    "gaps_totals": f"""WITH {GAP_SHOTS} SELECT coalesce(squad, 'NA') AS squad, count(*) AS shots,
        CASE WHEN count(xg) = count(*) THEN {XG_SUM} END AS xg_sum, round(avg(xg), 6) AS xg_mean,
        CASE WHEN count(xg) = count(*) THEN max(xg) END AS xg_max FROM gaps GROUP BY gaps.squad""",
    "gaps_on_target": f"""WITH {GAP_SHOTS} SELECT
        CASE WHEN outcome IN ('Goal', 'Saved') THEN 'On-Target' WHEN outcome IS NULL THEN 'NA' ELSE 'Off-Target' END AS on_target, count(*) AS n
      FROM gaps GROUP BY 1""",
    "gaps_null_keys": f"""WITH {GAP_SHOTS}, {RESULTS}, s AS (SELECT date, squad, count(*) AS shots FROM gaps GROUP BY date, squad),
      h AS (SELECT date, NULLIF(home, 'T2') AS home, away, home_goals, away_goals FROM results),
      b AS (SELECT date, home AS team, away AS opponent, home_goals AS gf FROM h UNION ALL SELECT date, away, home, away_goals FROM h)
      SELECT CAST(s.date AS VARCHAR) AS date, coalesce(squad, 'NA') AS squad, shots, coalesce(opponent, 'NA') AS opponent, coalesce(gf, -1) AS gf
      FROM s LEFT JOIN b ON s.date = b.date AND s.squad IS NOT DISTINCT FROM b.team""",
    "zone_spread_gaps": f"""WITH {GAP_AGAINST} SELECT zone, round(mean_gaa, 6) + 0.0e0 AS mean_gaa, round(sd_gaa, 6) AS sd_gaa FROM spread""",
    "zone_zscores_gaps": f"""WITH {GAP_AGAINST} SELECT team_abbreviation, zone, round(avg_gaa_96, 6) AS avg_gaa_96,
        round(avg_gaa, 6) AS avg_gaa, round(lg_avg_gaa_96, 6) AS lg_avg_gaa_96, round(lg_avg_gaa, 6) AS lg_avg_gaa,
        round(gaa_vs_lg_avg, 6) + 0.0e0 AS gaa_vs_lg_avg, round(gvla_96, 6) AS gvla_96,
        round(mean_gaa, 6) + 0.0e0 AS mean_gaa, round(sd_gaa, 6) AS sd_gaa,
        round((differences.gaa_vs_lg_avg - spread.mean_gaa) / NULLIF(spread.sd_gaa, 0), 6) AS sd_above_mean
      FROM differences LEFT JOIN spread USING (zone)""",
    "source_shots": f"""SELECT 'match-' || l_orderkey AS match_url, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, 'T' || (l_suppkey // 10) AS squad,
        CASE WHEN l_linenumber % 2 = 0 THEN 'Home' ELSE 'Away' END AS home_away, CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS match_half,
        CAST(l_quantity AS INTEGER) AS minute, 'P' || l_suppkey || CASE WHEN l_linenumber = 7 THEN ' (pen)' ELSE '' END AS player,
        CAST(l_discount AS VARCHAR) AS x_g, CASE l_returnflag WHEN 'R' THEN 'Goal' WHEN 'A' THEN 'Saved' ELSE 'Off Target' END AS outcome,
        CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS distance,
        CASE l_linenumber % 3 WHEN 0 THEN 'Head' WHEN 1 THEN 'Left Foot' ELSE 'Right Foot' END AS body_part, l_linestatus AS country,
        'M' AS gender, '1st' AS tier, CAST(year(l_shipdate) AS INTEGER) AS season_end_year
      FROM lineitem WHERE l_linestatus = 'O' AND year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders WHERE year(o_orderdate) >= 1996)""",
    "source_results": f"""WITH {RESULTS} SELECT CAST(date AS VARCHAR) AS date, home, away, home_goals, away_goals, 'USA' AS country, 'M' AS gender,
        '1st' AS tier, season_end_year FROM results WHERE season_end_year IN (1995, 1996, 1997)""",
    "source_teams": f"WITH {TEAMS} SELECT * FROM teams",
    "source_players": f"WITH {PLAYERS} SELECT * FROM players",
    "source_player_goals_added": f"""WITH {GA} SELECT * FROM ga WHERE CAST(season_name AS INTEGER) IN (
        SELECT year(o_orderdate) FROM orders WHERE year(o_orderdate) >= 1996)""",
    "source_goalkeeper_goals_added": f"WITH {GK} SELECT * FROM gk WHERE season_name IN ('1997', '1998')",
    "source_team_goals_added": f"""WITH {ZONES} SELECT * FROM zones WHERE zone IN (
        SELECT event_id % 30 + 1 FROM events WHERE event_id < 12)""",
    "source_salaries": f"""WITH {SALARIES} SELECT * REPLACE (CAST(mlspa_release AS VARCHAR) AS mlspa_release) FROM salaries
      WHERE season_name IN (1996, 1998)""",
    "source_rounds": """SELECT CAST(o_orderkey AS VARCHAR) AS round_id, CAST(113 + o_orderkey % 30 AS INTEGER) AS slope,
        CAST(68 + o_custkey % 8 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS rating, o_orderkey * 3600 + 5 * 3600 AS seconds FROM orders""",
    "source_posts": f"""WITH {POSTS}, c AS (SELECT title, unnest(list_distinct(categories)) AS category FROM posts)
      SELECT category, count(*) AS n FROM c GROUP BY category UNION ALL SELECT 'All', count(*) FROM posts""",
    "source_team_passing": f"""WITH {RESULTS}, s AS (SELECT *, unnest([home, away]) AS team FROM results)
      SELECT team, home AS home_team, away AS away_team,
        CASE WHEN home_goals = 3 AND away = 'T1' OR home_goals = 4 THEN -1 ELSE season_end_year END AS season_end_year,
        CASE WHEN home_goals = 3 AND away = 'T1' THEN 1 ELSE 0 END AS bad FROM s""",
    "source_bad_values": f"""WITH {RESULTS} SELECT 'season_end_year' AS "column", 2 * count(*) AS n, 'n/a' AS example FROM results
      WHERE home_goals = 3 AND away = 'T1' HAVING count(*) > 0""",
    "source_scorecards": """SELECT l_linenumber AS hole, l_returnflag AS tee_direction, count(*) AS n, CAST(sum(3 + l_linenumber % 3) AS BIGINT) AS par,
        CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2""",
}
