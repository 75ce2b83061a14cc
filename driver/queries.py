"""Registered queries: a library call over the views, shaped for the comparison with SQL.

Sums of two-decimal doubles are rounded to two decimals, since the order of additions differs
between engines. Means and fits are rounded to more digits than an exact tie can have, and to fewer
than the additions disturb. Dates are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import functions as fn
from courtside import operators as op
from courtside import plans
from driver import landing, views

Query = Callable[[SparkSession, str], DataFrame]

# The views' xG stops at 0.10, so the classes are cut lower.
CUTS = (0.08, 0.05, 0.03)
SHOT_SEASON = 1998
SALARY_SEASON = 1998
ZONE_SEASON = 2024


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return plans.clean_shots(views.shots(spark, sf), CUTS)


def league(spark: SparkSession, sf: str) -> DataFrame:
    return plans.clean_shots_single_league(views.shots(spark, sf))


def two_sided(spark: SparkSession, sf: str) -> DataFrame:
    return plans.two_sided_results(views.results(spark, sf))


def paid(spark: SparkSession, sf: str) -> DataFrame:
    return plans.season_salaries(
        views.salaries(spark, sf), views.players(spark, sf), views.teams(spark, sf), SALARY_SEASON
    )


def output(spark: SparkSession, sf: str, ordered: bool = False) -> DataFrame:
    nested = views.player_goals_added(spark, sf)
    return plans.salary_vs_output(nested, paid(spark, sf), SALARY_SEASON, ordered=ordered)


def points(spark: SparkSession, sf: str, ordered: bool = False) -> DataFrame:
    return plans.player_finishing(clean(spark, sf), as_points=True, ordered=ordered)


def against(spark: SparkSession, sf: str) -> DataFrame:
    return plans.zone_goals_against(views.team_goals_added(spark, sf), views.teams(spark, sf), ZONE_SEASON)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders")


# --- verbs ---------------------------------------------------------------------------------


def select_rename(spark, sf):
    return views.results(spark, sf).select(
        F.col("date").cast("string").alias("match_day"), F.col("home").alias("team"), F.col("away").alias("opponent")
    )


def drop_cols(spark, sf):
    return views.players(spark, sf).drop("nationality")


def positional_select(spark, sf):
    customers = views.table(spark, sf, "customer")
    chosen = customers.select(*op.positions(customers, 2, 4))
    return op.relocate_first(chosen, ["c_acctbal"])


def across_rates(spark, sf):
    sums = clean(spark, sf).groupBy("player", "season_end_year").agg(
        fn.rows().alias("shots"),
        *[fn.count_true(c).alias(name) for name, c in fn.finishing("separate").items()],
    )
    names = op.column_range(sums, "miss_target", "added_value")
    copies = op.across(sums, names, lambda c: fn.per(96 * c, "shots"), suffix="_p96")
    return op.across(copies, names, lambda c: fn.per(c, "shots"))


def separate_penalty(spark, sf):
    raw = op.clean_names(views.shots(spark, sf)).select("match_url", "minute", "player")
    split = op.separate(raw, "player", ("player", "penalty"), r" \(")
    return split.withColumn("penalty", F.when(F.col("penalty").isNull(), 0).otherwise(1))


def try_numeric(spark, sf):
    raw = op.clean_names(views.shots(spark, sf)).select("match_url", "x_g", "p_sx_g", "distance")
    return raw.select(
        "match_url",
        fn.num("x_g").alias("xg"),
        fn.num("p_sx_g").alias("psxg"),
        F.coalesce(fn.num("p_sx_g"), F.lit(0.0)).alias("psxg_filled"),
        fn.whole("distance").alias("distance"),
    )


def filter_or_and(spark, sf):
    c = F.col
    return (
        clean(spark, sf)
        .filter((c("squad") == "T0") | ((c("player") == "P12") & (c("country") != "O")))
        .filter(c("season_end_year").isin([1997, 1998, 1999]))
        .select("match_url", "player", "squad", "country", "season_end_year", "xg")
    )


def having_min_shots(spark, sf):
    counted = clean(spark, sf).groupBy(*plans.shots.PLAYER_KEYS).agg(fn.rows().alias("shots"))
    return counted.filter(F.col("shots") >= 40)


def latest_release(spark, sf):
    latest = op.keep_group_max(views.salaries(spark, sf), ["player_id"], "mlspa_release")
    return _text(latest.select("player_id", "mlspa_release", "base_salary"), "mlspa_release")


def name_match(spark, sf):
    return views.players(spark, sf).filter(fn.matches("player_name", "0[1-3]7$"))


def left_natural(spark, sf):
    return op.join_natural(
        views.salaries(spark, sf).select("player_id", "base_salary"),
        views.players(spark, sf).select("player_id", "player_name"),
        null_keys="never",
    )


def left_null_keys(spark, sf):
    """Orders by priority; the priority of one class is missing on both sides and must match."""
    priority = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority"
    left = orders(spark, sf).selectExpr("o_orderkey", priority)
    right = orders(spark, sf).selectExpr(priority).groupBy("priority").agg(fn.rows().alias("n"))
    joined = op.join_natural(left, right, null_keys="match")
    return joined.withColumn("priority", fn.label("priority"))


def left_composite(spark, sf):
    shots = league(spark, sf).select("match_url", "date", "squad", "xg")
    results = two_sided(spark, sf).select("date", F.col("team").alias("squad"), "opponent", "gf")
    joined = op.join_natural(shots, results, on=["date", "squad"], null_keys="never")
    return _text(joined.withColumn("opponent", fn.label("opponent")), "date")


def right_keep_all(spark, sf):
    output = views.player_goals_added(spark, sf).groupBy("player_id").agg(F.sum("minutes_played").alias("minutes"))
    return op.join_natural(output, views.players(spark, sf).select("player_id", "player_name"), how="right")


def outcome_counts(spark, sf):
    flags = fn.finishing("separate")
    summed = clean(spark, sf).groupBy("squad", "season_end_year").agg(
        fn.rows().alias("shots"),
        fn.total("xg").alias("xg_sum"),
        fn.count_true(fn.scored()).alias("goals"),
        *[fn.count_true(c).alias(name) for name, c in flags.items()],
    )
    return _round(summed, 2, "xg_sum")


def mean_sd_by_key(spark, sf):
    by = orders(spark, sf).groupBy(F.year("o_orderdate").alias("season"))
    return _round(
        by.agg(fn.mean("o_totalprice").alias("mean_price"), fn.sd("o_totalprice").alias("sd_price")),
        6,
        "mean_price",
        "sd_price",
    )


def min_max(spark, sf):
    return clean(spark, sf).groupBy("shot_class").agg(
        fn.smallest("xg").alias("xg_min"), fn.largest("xg").alias("xg_max")
    )


def totals_row(spark, sf):
    counted = clean(spark, sf).groupBy("season_end_year", "country").agg(
        fn.rows().alias("shots"), fn.count_true(fn.scored()).alias("goals")
    )
    rate = {"goal_pct": fn.per("goals", "shots")}
    return op.add_totals(counted.withColumns(rate), rate)


def expected_sot(spark, sf):
    counted = league(spark, sf).groupBy("squad").agg(fn.rows().alias("shots"), fn.total("on_target").alias("sot"))
    return plans.expected_on_target(counted, "shots", "sot")


def distinct_seasons(spark, sf):
    return plans.distinct_seasons(league(spark, sf))


def xg_cdf(spark, sf):
    counted = clean(spark, sf).groupBy("xg").agg(fn.rows().alias("n"))
    return op.running_share(counted, "xg", "n", "cdf")


def share_of_total(spark, sf):
    counted = clean(spark, sf).groupBy("player").agg(fn.rows().alias("n"))
    return op.share_of_total(counted, "n", "pct")


def dev_from_group(spark, sf):
    shots = clean(spark, sf).select("match_url", "minute", "squad", "xg")
    with_mean = op.with_group_stats(shots, ["squad"], {"squad_mean": fn.mean("xg")})
    return _round(with_mean.withColumn("dev", F.col("squad_mean") - F.col("xg")), 6, "squad_mean", "dev")


def group_zscore(spark, sf):
    zones = against(spark, sf).select("team_abbreviation", "zone", "team_goals_added_against")
    x = "team_goals_added_against"
    stats = op.with_group_stats(op.reuse_point(zones), ["zone"], {"zone_mean": fn.mean(x), "zone_sd": fn.sd(x)})
    z = stats.withColumn("z", fn.per(F.col(x) - F.col("zone_mean"), "zone_sd"))
    return _round(z, 6, x, "zone_mean", "zone_sd", "z")


def sorted_topk(spark, sf):
    return op.top(orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice"), 25, "-o_totalprice", "o_orderkey")


def union_by_name(spark, sf):
    home = views.results(spark, sf).select(F.col("home").alias("team"), F.col("home_goals").alias("gf"), "season_end_year")
    away = views.results(spark, sf).select(F.col("season_end_year"), F.col("away").alias("team"))
    joined = op.union_by_name(home, away)
    return joined.withColumn("gf", F.coalesce("gf", F.lit(-1)))


def unnest_actions(spark, sf):
    return op.unnest(views.player_goals_added(spark, sf), "data")


def explode_teams(spark, sf):
    return op.unnest_vector(views.goalkeeper_goals_added(spark, sf).drop("data"), "team_id")


def pivot_actions(spark, sf):
    long = op.unnest(views.player_goals_added(spark, sf), "data").drop("count_actions", "goals_added_above_avg")
    return op.pivot_wider(long, "action_type", "goals_added_raw", plans.goals_added.ACTIONS)


def pivot_fill(spark, sf):
    long = plans.team_zone_long(views.team_goals_added(spark, sf)).drop(*plans.zones.OTHER_MEASURES)
    return op.pivot_wider(long, "action_type", "goals_added_against", plans.zones.AGAINST_ACTIONS, fill=0.0)


def ols(spark, sf):
    return _round(op.ols(orders(spark, sf), "o_totalprice", "o_custkey"), 6, "intercept", "slope", "r_squared")


def ols_residuals(spark, sf):
    fitted = op.add_fit(orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey")
    return _round(fitted, 2, "fitted", "residual")


def per96(spark, sf):
    return plans.team_zone_long(views.team_goals_added(spark, sf)).select(
        "team_id",
        "zone",
        "action_type",
        fn.per96("goals_added_against", "minutes").alias("against_p96"),
        fn.nineties("minutes").alias("m90s"),
    )


def half_even_round(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        fn.half_even(F.col("l_quantity") / 2).alias("half_quantity"),
        fn.half_even_2(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
    )


def label_concat(spark, sf):
    raw = op.clean_names(views.shots(spark, sf))
    return raw.select(
        "match_url",
        fn.label("player", F.lit("("), fn.num("p_sx_g"), F.lit(")"), sep="").alias("with_psxg"),
        fn.label("squad", "season_end_year", sep=" - ").alias("label"),
    )


def log10_salary(spark, sf):
    salaries = views.salaries(spark, sf).withColumn("salary", fn.in_thousands("base_salary"))
    return _round(plans.log_salary(salaries).select("player_id", "salary", "log10_salary"), 6, "log10_salary")


def clock_time(spark, sf):
    """Order days as local times, in turn with four zones, read back as seconds since 1970 in UTC."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ("JST", "EST", "EDT", "+02:00")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    told = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), zone)
    return orders(spark, sf).select("o_orderkey", F.unix_seconds(fn.clock_time(told)).alias("seconds"))


def latest_release_gaps(spark, sf):
    """A player with a release whose day is missing has no known latest one."""
    latest = op.keep_group_max(views.salaries_with_gaps(spark, sf), ["player_id"], "mlspa_release", nulls="propagate")
    return _text(latest.select("player_id", "mlspa_release", "base_salary"), "mlspa_release")


def latest_release_many_ties(spark, sf):
    """The rank's other form: joined on the player and the latest year."""
    years = views.salaries(spark, sf).select("player_id", "season_name", "base_salary")
    return op.keep_group_max(years, ["player_id"], "season_name", ties="many")


def price_cdf(spark, sf):
    """Running share of orders by rising price, which is far outside 0 to 1."""
    counted = orders(spark, sf).groupBy("o_totalprice").agg(fn.rows().alias("n"))
    return op.running_share(counted, "o_totalprice", "n", "cdf")


def fit_band(spark, sf):
    fitted = op.add_fit(orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey", 0.95)
    return _round(fitted.drop("residual"), 2, "fitted", "lower", "upper")


def totals_row_sum_all(spark, sf):
    counted = clean(spark, sf).groupBy("season_end_year", "country").agg(
        fn.rows().alias("shots"), fn.count_true(fn.scored()).alias("goals")
    )
    return _round(op.add_totals(counted.withColumn("goal_pct", fn.per("goals", "shots")), mode="sum_all"), 8, "goal_pct")


def grouped_totals(spark, sf):
    """Groups and their total from one aggregate; the total of a smallest xG is no sum."""
    measures = {"shots": fn.rows(), "goals": fn.count_true(fn.scored()), "xg_min": fn.smallest("xg")}
    return op.totals_by(clean(spark, sf), ["season_end_year", "country"], measures, {"goal_pct": fn.per("goals", "shots")})


def pivot_doubled(spark, sf):
    """Every action twice in its row: the cells are sums."""
    doubled = views.player_goals_added(spark, sf).withColumn("data", F.concat("data", "data"))
    return op.pivot_nested(doubled, "data", "action_type", "goals_added_raw", plans.goals_added.ACTIONS, duplicates="sum")


def left_unique(spark, sf):
    """Salaries with their player, who must not repeat."""
    players = views.players(spark, sf).select("player_id", "player_name")
    return op.join_natural(views.salaries(spark, sf).select("player_id", "base_salary"), players, null_keys="never", unique_right=True)


def gaps_totals(spark, sf):
    """Sums that a missing xG makes missing; the squads that are missing are one group."""
    summed = views.shots_with_gaps(spark, sf).groupBy("squad").agg(
        fn.rows().alias("shots"), fn.total("xg", "propagate").alias("xg_sum"), fn.mean("xg", "skip").alias("xg_mean"), fn.largest("xg", "propagate").alias("xg_max")
    )
    return _round(_round(summed, 2, "xg_sum"), 6, "xg_mean").withColumn("squad", fn.label("squad"))


def gaps_on_target(spark, sf):
    """A missing outcome is neither on nor off target."""
    return plans.on_target_by_outcome(views.shots_with_gaps(spark, sf)).withColumn("on_target", fn.label("on_target"))


def gaps_null_keys(spark, sf):
    """Shots per day and squad meet the day's results, a missing squad those of a missing team."""
    daily = views.shots_with_gaps(spark, sf).groupBy("date", "squad").agg(fn.rows().alias("shots"))
    results = plans.two_sided_results(views.results_with_gaps(spark, sf))
    joined = plans.shots_with_opponent(daily, results, null_keys="match").select("date", "squad", "shots", "opponent", "gf")
    labels = {c: fn.label(c) for c in ("squad", "opponent")}
    return _text(joined.withColumns(labels | {"gf": F.coalesce("gf", F.lit(-1))}), "date")


def against_gaps(spark, sf):
    return plans.zone_goals_against(views.team_goals_added_with_gaps(spark, sf), views.teams(spark, sf), ZONE_SEASON)


def zone_spread_gaps(spark, sf):
    return _round(plans.zone_spread(against_gaps(spark, sf), nulls="propagate"), 6, "mean_gaa", "sd_gaa")


def zone_zscores_gaps(spark, sf):
    scores = plans.zone_zscores(against_gaps(spark, sf), nulls="propagate")
    return _round(scores, 6, *[c for c in scores.columns if c not in ("team_abbreviation", "zone")])


# --- composites ----------------------------------------------------------------------------


def clean_shots(spark, sf):
    return _text(clean(spark, sf), "date")


def shot_class_summary(spark, sf):
    return plans.shot_class_summary(clean(spark, sf))


def xg_distribution(spark, sf):
    return plans.xg_distribution(clean(spark, sf), CUTS)


def on_target_by_outcome(spark, sf):
    return plans.on_target_by_outcome(clean(spark, sf))


def season_averages(spark, sf):
    return plans.season_averages(clean(spark, sf))


def player_finishing(spark, sf):
    return _round(plans.player_finishing(clean(spark, sf)), 2, "xg_sum", "goals_diff")


def player_finishing_points(spark, sf):
    return _round(points(spark, sf, ordered=True), 2, "xg_sum", "goals_diff")


def finishing_model(spark, sf):
    return _round(plans.finishing_model(points(spark, sf)), 6, "intercept", "slope", "r_squared")


def fitted_points(spark, sf):
    fitted = plans.fitted_points(points(spark, sf))
    keep = [*plans.shots.PLAYER_KEYS, "goals_diff", "added_value_diff", "fitted", "residual"]
    return _round(_round(fitted.select(*keep), 2, "goals_diff"), 6, "fitted", "residual")


def highlight_player(spark, sf):
    shown = plans.highlight_player(points(spark, sf), "^P[1-3]$")
    return _round(shown.select("player", "label", "shots", "goals_diff"), 2, "goals_diff")


def player_title(spark, sf):
    return plans.player_title(points(spark, sf), "^P[1-3]$", "Against Expectation")


def team_finishing(spark, sf):
    return _round(plans.team_finishing(clean(spark, sf)), 2, "xg", "psxg", "xgdiff", "psxgdiff")


def clean_shots_single_league(spark, sf):
    return _text(
        league(spark, sf).select("match_url", "date", "squad", "player", "xg", "psxg", "on_target", "season_end_year"),
        "date",
    )


def two_sided_results(spark, sf):
    return _text(two_sided(spark, sf), "date")


def shots_with_opponent(spark, sf):
    shots = league(spark, sf).select("match_url", "date", "squad", "home_away", "xg", "on_target")
    joined = plans.shots_with_opponent(shots, two_sided(spark, sf))
    goals = {c: F.coalesce(c, F.lit(-1)) for c in ("gf", "ga")}
    labels = {c: fn.label(c) for c in ("opponent", "home_away_r")}
    return _text(joined.withColumns(goals | labels), "date")


def shots_allowed(spark, sf):
    allowed = plans.shots_allowed(league(spark, sf), two_sided(spark, sf), SHOT_SEASON)
    return _round(allowed.withColumn("opponent", fn.label("opponent")), 2, "xg_allowed").withColumns(
        {c: F.round(c, 6) for c in ("sot_exp", "sot_res")}
    )


def season_salaries(spark, sf):
    return _text(paid(spark, sf), "mlspa_release")


def team_wage_bill(spark, sf):
    bill = plans.team_wage_bill(paid(spark, sf), "N3")
    return _text(bill.select("player_id", "player_name", "mlspa_release", "guaranteed_compensation"), "mlspa_release")


def salary_vs_output(spark, sf):
    joined = output(spark, sf, ordered=True).withColumn("general_position", fn.label("general_position"))
    return _text(joined, "mlspa_release")


def goals_added_moments(spark, sf):
    moments = plans.goals_added_moments(views.player_goals_added(spark, sf), SALARY_SEASON)
    return _round(moments, 8, "mean_gadd_player", "sd_gadd_player")


def goalkeeper_rows(spark, sf):
    return plans.goalkeeper_rows(
        views.goalkeeper_goals_added(spark, sf), views.players(spark, sf), views.teams(spark, sf), [1996, 1997, 1998]
    )


def goalkeeper_goals_added(spark, sf):
    where: Column = (F.col("team_abbreviation") == "N4") | (F.col("player_id") == "7")
    summed = plans.goalkeeper_goals_added(
        views.goalkeeper_goals_added(spark, sf),
        views.players(spark, sf),
        views.teams(spark, sf),
        [1996, 1997, 1998],
        where,
    )
    return _round(summed, 2, "goals_added_raw")


def position_filter(spark, sf):
    backs = plans.position_filter(output(spark, sf), "CB")
    return backs.select("player_id", "player_name", "salary", "m90s", "gadd_player")


def team_match_opponent(spark, sf):
    return plans.team_match_opponent(views.team_stats(spark, sf), SHOT_SEASON)


def player_goals_added_p96(spark, sf):
    where = (F.col("team_abbreviation") == "N3") | (
        (F.col("player_name") == "Customer#000000008") & (F.col("team_abbreviation") != "N5")
    )
    return plans.player_goals_added_p96(
        views.player_goals_added(spark, sf), views.players(spark, sf), views.teams(spark, sf), SALARY_SEASON, where
    )


def team_zone_long(spark, sf):
    return plans.team_zone_long(views.team_goals_added(spark, sf))


def zone_goals_against(spark, sf):
    return against(spark, sf)


def zone_league_average(spark, sf):
    return _round(plans.zone_league_average(against(spark, sf)), 6, "lg_avg_gaa_96", "lg_avg_gaa")


def zone_spread(spark, sf):
    return _round(plans.zone_spread(against(spark, sf)), 6, "mean_gaa", "sd_gaa")


def zone_zscores(spark, sf):
    scores = plans.zone_zscores(against(spark, sf))
    return _round(scores, 6, *[c for c in scores.columns if c not in ("team_abbreviation", "zone")])


def course_handicap(spark, sf):
    return plans.course_handicap(views.rounds(spark, sf), views.holes(spark, sf))


def salary_bands(spark, sf):
    return _round(plans.salary_bands(output(spark, sf), lines=(50.0, 200.0, 600.0)), 8, "mean_output")


def post_listing(spark, sf):
    listed = plans.post_listing(views.posts(spark, sf))
    return listed.select("title", "author", F.col("date").cast("string"), F.array_join("categories", ",").alias("categories"))


def category_counts(spark, sf):
    return plans.category_counts(views.posts(spark, sf))


def category_filter(spark, sf):
    return plans.category_filter(views.posts(spark, sf), "fr").select("title", "author")


VERBS: list[Query] = [
    select_rename,
    drop_cols,
    positional_select,
    across_rates,
    separate_penalty,
    try_numeric,
    filter_or_and,
    having_min_shots,
    latest_release,
    name_match,
    left_natural,
    left_null_keys,
    left_composite,
    right_keep_all,
    outcome_counts,
    mean_sd_by_key,
    min_max,
    totals_row,
    expected_sot,
    distinct_seasons,
    xg_cdf,
    share_of_total,
    dev_from_group,
    group_zscore,
    sorted_topk,
    union_by_name,
    unnest_actions,
    explode_teams,
    pivot_actions,
    pivot_fill,
    ols,
    ols_residuals,
    per96,
    half_even_round,
    label_concat,
    log10_salary,
    clock_time,
    latest_release_gaps,
    latest_release_many_ties,
    price_cdf,
    fit_band,
    totals_row_sum_all,
    grouped_totals,
    pivot_doubled,
    left_unique,
    gaps_totals,
    gaps_on_target,
    gaps_null_keys,
    zone_spread_gaps,
    zone_zscores_gaps,
]

COMPOSITES: list[Query] = [
    clean_shots,
    shot_class_summary,
    xg_distribution,
    on_target_by_outcome,
    season_averages,
    player_finishing,
    player_finishing_points,
    finishing_model,
    fitted_points,
    highlight_player,
    player_title,
    team_finishing,
    clean_shots_single_league,
    two_sided_results,
    shots_with_opponent,
    shots_allowed,
    season_salaries,
    team_wage_bill,
    salary_vs_output,
    goals_added_moments,
    goalkeeper_rows,
    goalkeeper_goals_added,
    position_filter,
    team_match_opponent,
    player_goals_added_p96,
    team_zone_long,
    zone_goals_against,
    zone_league_average,
    zone_spread,
    zone_zscores,
    course_handicap,
    salary_bands,
    post_listing,
    category_counts,
    category_filter,
]

QUERIES: dict[str, Query] = {query.__name__: query for query in [*VERBS, *COMPOSITES, *landing.QUERIES]}
QUERIES["two_sided"] = two_sided_results
