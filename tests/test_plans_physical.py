"""The physical plans the queries are meant to have, also when nothing is small enough to broadcast."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtside import functions as fn
from courtside import operators as op
from courtside.operators import shares
from driver.queries import clean, league, points, two_sided
from driver import landing, views
from courtside import plans
from helpers import final_plan, rows

SF = "/root/testdata/sf0.001"


def _counts(df):
    plan = final_plan(df)
    return {
        "scans": plan.count("FileScan"),
        "shuffles": plan.count(" Exchange ") ,
        "reused": plan.count("ReusedExchange"),
        "products": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "plan": plan,
    }


@pytest.mark.parametrize("as_points", [False, True])
def test_finishing_reads_the_shots_once(spark, as_points):
    found = _counts(plans.player_finishing(clean(spark, SF), as_points=as_points))
    assert found["scans"] == 1 and found["reused"] == 1


def test_model_needs_no_sort(spark):
    plan = final_plan(plans.finishing_model(points(spark, SF)))
    assert "rangepartitioning" not in plan


def test_totals_row_reads_once(spark):
    found = _counts(plans.shots_allowed(league(spark, SF), two_sided(spark, SF), 1998))
    assert found["scans"] == 2 and found["reused"] == 1


def test_nested_pivot_adds_no_shuffle(spark):
    nested = views.player_goals_added(spark, SF)
    before = _counts(nested)["shuffles"]
    wide = op.pivot_nested(nested, "data", "action_type", "goals_added_raw", plans.goals_added.ACTIONS)
    assert _counts(wide)["shuffles"] == before


def test_zone_scores_scan_the_events_once(spark):
    found = _counts(entry.queries()["zone_zscores"](spark, SF))
    assert found["scans"] == 2  # events and nation


def test_sorted_limit_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in final_plan(entry.queries()["sorted_topk"](spark, SF))


def test_filters_reach_the_scan(spark):
    shots = views.table(spark, SF, "orders").withColumnRenamed("o_custkey", "player_id")
    kept = op.keep_group_max(shots.filter("player_id = 5"), ["player_id"], "o_orderdate")
    assert final_plan(kept).count("EqualTo(o_custkey,5)") == 1


def test_no_query_joins_without_keys(no_broadcast):
    for name in ("shots_with_opponent", "player_finishing", "zone_zscores", "shots_allowed", "xg_distribution"):
        assert _counts(entry.queries()[name](no_broadcast, SF))["products"] == 0, name


def test_large_sides_are_sort_merge_joined(no_broadcast):
    plan = final_plan(entry.queries()["left_natural"](no_broadcast, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.fixture
def skew_settings(no_broadcast):
    spark = no_broadcast
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("hot", ["key", "null"])
def test_a_key_with_a_third_of_the_rows_is_split(skew_settings, hot):
    """One key, or the null key, holds a third of the rows; its partition is cut up and no row is lost."""
    spark = skew_settings
    key = F.when(F.col("id") % 3 == 0, F.lit(None if hot == "null" else -1)).otherwise(F.col("id") % 5000)
    # Several input tasks: a skewed partition is cut between the map outputs it consists of.
    big = spark.range(0, 120_000, numPartitions=16).select(
        key.alias("k"), F.xxhash64("id").alias("x"), F.xxhash64(F.col("id") + 1).alias("y")
    )
    found = op.with_group_stats(big, ["k"], {"n": fn.rows(), "top": fn.largest("x")})
    plan = final_plan(found)
    assert "skew=true" in plan
    hot_rows = found.filter(F.col("k").isNull() if hot == "null" else F.col("k") == -1)
    assert hot_rows.agg(F.count("*"), F.min("n"), F.max("n")).first() == (40_000, 40_000, 40_000)
    assert found.count() == 120_000


def test_group_maximum_of_a_hot_group_is_spread(skew_settings):
    spark = skew_settings
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    big = spark.range(0, 120_000, numPartitions=16).select(key.alias("k"), (F.col("id") % 1000).alias("release"))
    kept = op.keep_group_max(big, ["k"], "release", ties="many")
    assert "hashpartitioning(release" in final_plan(kept) or "release" in final_plan(kept).split("hashpartitioning(")[1]
    top = {r.k: r.m for r in big.groupBy("k").agg(F.max("release").alias("m")).collect()}
    expected = [(r.k, r.release) for r in big.collect() if r.release == top[r.k]]
    assert sorted((r.k, r.release) for r in kept.collect()) == sorted(expected)


def test_group_maximum_is_one_scan_and_one_shuffle(spark):
    found = _counts(entry.queries()["latest_release"](spark, SF))
    assert found["scans"] == 1 and found["shuffles"] == 1 and "WindowGroupLimit" in found["plan"]
    # salaries, events, players and teams: each is read once
    assert _counts(entry.queries()["salary_vs_output"](spark, SF))["scans"] == 4
    assert _counts(entry.queries()["team_wage_bill"](spark, SF))["scans"] == 3


def test_a_hot_group_is_cut_down_before_the_shuffle(spark):
    """A third of the rows are one group: of each task's rows only its largest leave it."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    big = spark.range(0, 120_000, numPartitions=16).select(key.alias("k"), F.xxhash64("id").alias("release"))
    kept = op.keep_group_max(big, ["k"], "release")
    plan = kept.select("k", "release")
    assert plan.filter("k = -1").count() == 1
    final = final_plan(kept)
    assert final.count("WindowGroupLimit") == 2 and final.index("WindowGroupLimit") < final.index(" Exchange ") < final.rindex("WindowGroupLimit")


def test_grouped_totals_are_one_scan_and_one_shuffle(spark):
    found = _counts(entry.queries()["grouped_totals"](spark, SF))
    assert found["scans"] == 1 and found["shuffles"] == 1


def test_group_zscore_computes_its_input_once(spark):
    assert _counts(entry.queries()["group_zscore"](spark, SF))["scans"] == 2  # events and nation


def test_running_share_spreads_values_outside_the_unit(spark):
    df = spark.range(10, 2000).select(F.col("id").alias("x"), F.lit(1).alias("n"))
    sizes = [r["count"] for r in shares.add_quantile_step(df, "x", "step", 64).groupBy("step").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 80
    assert all(abs(r.cdf - (r.x - 9) / 1990) < 1e-12 for r in op.running_share(df, "x", "n", "cdf", steps=64).collect())


def test_tables_of_seasons_and_zones_prune_when_the_query_runs(spark):
    """The partitions come from a filtered table: Spark hands its values to the scan, which opens those alone."""
    for query, by in (("source_shots", "season_end_year"), ("source_team_goals_added", "zone"), ("source_player_goals_added", "season_name")):
        found = entry.queries()[query](spark, SF)
        partitions = found.select(by).distinct().count()
        plan = final_plan(found)
        assert "dynamicpruning" in plan, query
        scans = [node for node in _nodes(found._jdf.queryExecution().executedPlan()) if node.nodeName().startswith("Scan")]
        read = [node.metrics().apply("numPartitions").value() for node in scans if node.metrics().contains("numPartitions")]
        assert max(read) == partitions, (query, read)


def test_landing_by_folder_sorts_no_rows(spark):
    """A sort of each task's rows by folder spills where a task has many."""
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for land, view in ((landing.shots_path, views.shots), (landing.zones_path, views.team_goals_added)):
        path = land(spark, SF)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        plan = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
        assert "WriteFiles" in plan and "Sort" not in plan.replace("SortAggregate", "")
        assert spark.read.parquet(path).count() == view(spark, SF).count()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def _nodes(node):
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        node = node.executedPlan()
    if "QueryStage" in node.nodeName():
        node = node.plan()
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def test_a_checked_join_is_one_job_and_fails_on_a_doubled_key(spark):
    left = spark.createDataFrame([("Reds", 1, 5)], "squad string, date int, xg int")
    once = spark.createDataFrame([("Reds", 1, 2), ("Blues", 1, 3)], "squad string, date int, gf int")
    joined = op.join_natural(left, once, on=["date", "squad"], unique_right=True)
    assert rows(joined) == [("Reds", 1, 5, 2)]
    twice = op.join_natural(left, once.union(once), on=["date", "squad"], unique_right=True)
    with pytest.raises(Exception, match="key is not unique: date=1, squad=Reds"):
        twice.filter("squad = 'Reds'").collect()


def test_results_do_not_depend_on_join_strategy(no_broadcast):
    from oracle_check import connect, difference

    con = connect(SF)
    for name in ("left_null_keys", "right_keep_all", "latest_release", "salary_vs_output", "zone_zscores", "xg_cdf"):
        assert difference(entry.queries()[name](no_broadcast, SF), con, entry.oracle_sql()[name]) is None, name


def test_rows_helper_orders(spark):
    assert rows(spark.createDataFrame([(2,), (None,), (1,)], "x int")) == [(1,), (2,), (None,)]
