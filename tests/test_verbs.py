"""Column verbs, shares, totals."""

import pytest
from pyspark.sql import functions as F

from courtside import functions as fn
from courtside import operators as op
from courtside.operators.columns import snake
from helpers import rows


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("xG", "x_g"),
        ("PSxG", "p_sx_g"),
        ("Tee Direction", "tee_direction"),
        ("Par", "par"),
        ("Season_End_Year", "season_end_year"),
        ("Match_URL", "match_url"),
        ("Drops from Tee", "drops_from_tee"),
        ("HomeGoals", "home_goals"),
        ("% won", "percent_won"),
        ("90s", "x90s"),
        ("already_fine", "already_fine"),
    ],
)
def test_snake(name, expected):
    assert snake(name) == expected


def test_clean_names_numbers_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a.b` int, a_b int")
    assert op.clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]
    assert rows(op.clean_names(df)) == [(1, 2, 3)]


def test_positions_ranges_and_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert op.positions(df, 2, 3) == ["b", "c"]
    assert op.column_range(df, "b", "d") == ["b", "c", "d"]
    assert op.relocate_first(df, ["c"]).columns == ["c", "a", "b", "d"]
    with pytest.raises(ValueError):
        op.positions(df, 2, 5)
    with pytest.raises(ValueError):
        op.column_range(df, "c", "b")


def test_across_in_place_and_as_copies(spark):
    df = spark.createDataFrame([(2, 4, 8)], "n int, a int, b int")
    assert rows(op.across(df, ["a", "b"], lambda c: fn.per(c, "n"))) == [(2, 2.0, 4.0)]
    copies = op.across(df, ["a", "b"], lambda c: c * 10, suffix="_x")
    assert copies.columns == ["n", "a", "b", "a_x", "b_x"]
    assert rows(copies) == [(2, 4, 8, 40, 80)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    assert rows(op.share_of_total(df, "n", "pct")) == [("a", 1, 0.25), ("b", 3, 0.75)]


def test_running_share_over_values_of_all_kinds(spark):
    values = [0.0, 0.000004, 0.000005, 0.3, 0.3000001, 0.999999, 1.0, 7.5, -2.0, None]
    df = spark.createDataFrame([(x, i + 1) for i, x in enumerate(values)], "x double, n int")
    found = {r.x: r.cdf for r in op.running_share(df, "x", "n", "cdf").collect()}
    running, total = 0, sum(range(1, 11))
    for x in sorted((v for v in values if v is not None)) + [None]:
        running += values.index(x) + 1
        assert found[x] == running / total
    assert found[None] == 1.0


def test_running_share_with_own_steps(spark):
    df = spark.createDataFrame([(x, 1) for x in range(100)], "x int, n int")
    found = op.running_share(df, "x", "n", "cdf", step=lambda x: F.floor(x / 10)).collect()
    assert all(r.cdf == (r.x + 1) / 100 for r in found)


def test_totals_row_recomputes_or_sums_ratios(spark):
    df = spark.createDataFrame([(2023, "A", 1, 4), (2023, "B", 3, 4)], "season int, team string, goals int, shots int")
    ratio = {"pct": fn.per("goals", "shots")}
    table = df.withColumns(ratio)
    assert rows(op.add_totals(table, ratio)) == [
        ("2023", "A", 1, 4, 0.25),
        ("2023", "B", 3, 4, 0.75),
        ("Total", "-", 4, 8, 0.5),
    ]
    assert rows(op.add_totals(table, ratio, mode="sum_all"))[-1] == ("Total", "-", 4, 8, 1.0)
    with pytest.raises(ValueError):
        op.add_totals(table, mode="other")


def test_group_stats_equal_a_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", 7.0)], "k string, x double")
    found = op.with_group_stats(df, ["k"], {"m": fn.mean("x")})
    assert rows(found) == [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 7.0, 7.0), (None, 5.0, 5.0)]


def test_two_sides(spark):
    df = spark.createDataFrame([(1, 2)], "l int, r int")
    both = op.two_sides(df, [{"us": F.col("l"), "them": F.col("r")}, {"us": F.col("r"), "them": F.col("l")}])
    assert rows(both) == [(1, 2), (2, 1)]


def test_reuse_point_changes_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert op.reuse_point(df).schema.simpleString() == df.schema.simpleString()
    assert rows(op.reuse_point(df)) == rows(df)


def test_stage_writes_to_the_checkpoint_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    staged = op.stage(df)
    assert rows(staged) == rows(df)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_stage_uses_the_folder_the_session_names():
    from courtside.operators import reuse

    chosen = []

    class Context:
        master = "spark://cluster"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            chosen.append(folder)

    class Session:
        sparkContext = Context()

        def __init__(self, **settings):
            self.conf = settings

    class Frame:
        def __init__(self, session):
            self.sparkSession = session

        def checkpoint(self, eager):
            return self

    reuse.stage(Frame(Session(**{"spark.checkpoint.dir": "shared://folder"})))
    assert chosen == ["shared://folder"]
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        reuse.stage(Frame(Session()))
