"""One small case per rule where a plain translation to Spark gives another answer."""

import datetime

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from courtside import functions as fn
from courtside import operators as op
from courtside import plans
from courtside.operators.columns import snake
from helpers import rows


def test_joins_match_null_keys_unless_told_not_to(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert rows(op.join_natural(left, right)) == [("a", 1, 10), (None, 2, 20)]
    assert rows(op.join_natural(left, right, null_keys="never")) == [("a", 1, 10), (None, 2, None)]


def test_keys_are_the_shared_names_in_left_order(spark):
    left = spark.createDataFrame([(1, 2, 3)], "b int, a int, x int")
    right = spark.createDataFrame([(2, 1, 9)], "a int, b int, y int")
    assert op.natural_keys(left, right) == ["b", "a"]
    assert op.join_natural(left, right).columns == ["b", "a", "x", "y"]
    with pytest.raises(ValueError, match="share no column"):
        op.natural_keys(left, right.select("y"))


@pytest.mark.parametrize("null_keys", ["match", "never"])
def test_other_shared_names_get_a_suffix(spark, null_keys):
    left = spark.createDataFrame([(1, "l")], "k int, v string")
    right = spark.createDataFrame([(1, "r")], "k int, v string")
    joined = op.join_natural(left, right, on=["k"], null_keys=null_keys)
    assert joined.columns == ["k", "v", "v_r"]
    assert rows(joined) == [(1, "l", "r")]


@pytest.mark.parametrize("null_keys", ["match", "never"])
def test_right_join_keeps_right_rows_and_keys(spark, null_keys):
    left = spark.createDataFrame([(1, "l1"), (2, "l2")], "k int, v string")
    right = spark.createDataFrame([(1, "r1"), (3, "r3")], "k int, w string")
    joined = op.join_natural(left, right, how="right", null_keys=null_keys)
    assert joined.columns == ["k", "v", "w"]
    assert rows(joined) == [(1, "l1", "r1"), (3, None, "r3")]


def test_blank_and_bad_text_become_null(spark):
    df = spark.createDataFrame([("0.5",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.num("t")).collect()] == [0.5, None, None, None]
    assert [r[0] for r in df.select(fn.whole("t")).collect()] == [None, None, None, None]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "x double, y double")
    assert [r[0] for r in df.select(fn.per("x", "y")).collect()] == [None, 0.25]
    assert [r[0] for r in df.select(fn.per96("x", "y")).collect()] == [None, 24.0]


def test_null_rule_of_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k string, x double")
    by = df.groupBy("k")
    for aggregate in (fn.total, fn.mean, fn.sd, fn.smallest, fn.largest):
        skip = dict(by.agg(aggregate("x").alias("v")).collect())
        keep = dict(by.agg(aggregate("x", "propagate").alias("v")).collect())
        assert keep["a"] == skip["a"]
        assert keep["b"] is None
    assert rows(by.agg(fn.count_true(F.col("x") > 0, "propagate"))) == [("a", 2), ("b", None)]
    assert rows(by.agg(fn.count_true(F.col("x") > 0))) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        fn.total("x", "drop")


def test_nested_total_follows_the_same_rule(spark):
    df = spark.createDataFrame(
        [(1, [(1.0,), (2.0,)]), (2, [(1.0,), (None,)]), (3, [(None,)])], "k int, data array<struct<v:double>>"
    )
    assert rows(df.select("k", fn.nested_total("data", "v"))) == [(1, 3.0), (2, 1.0), (3, None)]
    assert rows(df.select("k", fn.nested_total("data", "v", "propagate"))) == [(1, 3.0), (2, None), (3, None)]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r[0] for r in op.arrange(df, "x").collect()] == [1, 2, None]
    assert [r[0] for r in op.arrange(df, "-x").collect()] == [2, 1, None]
    assert [r[0] for r in op.top(df, 2, "-x").collect()] == [2, 1]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.half_even("x")).collect()] == [0.0, 2.0, 2.0, -2.0, None]
    two = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert [r[0] for r in two.select(fn.half_even_2("x")).collect()] == [0.12, 0.38]


def test_separate_fills_missing_pieces_and_drops_surplus(spark):
    df = spark.createDataFrame([(1, "A (pen)", 2), (1, "B", 2), (1, "C (x) (y)", 2), (1, None, 2)], "a int, p string, z int")
    expected = [(1, "A", "pen)", 2), (1, "B", None, 2), (1, "C", "x)", 2), (1, None, None, 2)]
    for split in (
        op.separate(df, "p", ("name", "rest"), r" \("),
        op.separate(df, "p", ("name", "rest"), " (", literal=True),
    ):
        assert split.columns == ["a", "name", "rest", "z"]
        assert rows(split) == expected


def test_separate_into_three_literal_equals_regex(spark):
    df = spark.createDataFrame([("a-b-c",), ("a-b",), ("a",), ("",), ("-",), ("a--c-d",)], "p string")
    by_regex = op.separate(df, "p", ("x", "y", "z"), "-")
    by_text = op.separate(df, "p", ("x", "y", "z"), "-", literal=True)
    assert rows(by_regex) == rows(by_text)


def test_times_keep_their_zone(spark):
    told = {
        "2024-01-27 09:20:00 EST": "2024-01-27 14:20:00",
        "2024-07-27 09:20:00 EST": "2024-07-27 14:20:00",
        "2024-07-27 09:20:00 EDT": "2024-07-27 13:20:00",
        "2024-07-27 09:20:00 JST": "2024-07-27 00:20:00",
        "2024-07-27 09:20:00 +02:00": "2024-07-27 07:20:00",
        "2024-07-27 09:20:00 America/New_York": "2024-07-27 13:20:00",
        "2024-07-27 09:20:00": "2024-07-27 09:20:00",
        "2024-07-27 09:20:00 XQZ": None,
        "soon": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(x,) for x in told], "t string")
    found = [r[0] for r in df.select(fn.clock_time("t").cast("string")).collect()]
    assert found == list(told.values())


def test_labels_show_missing_pieces(spark):
    df = spark.createDataFrame([("T1", 2021), (None, 2022), ("T3", None)], "squad string, season int")
    found = [r[0] for r in df.select(fn.label("squad", "season", sep=" - ")).collect()]
    assert found == ["T1 - 2021", "NA - 2022", "T3 - NA"]


def test_numbers_in_labels_have_no_trailing_zeros(spark):
    df = spark.createDataFrame([(0.1236,), (2.0,), (100.0,), (-0.0001,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.label(fn.decimals("x", 3))).collect()] == ["0.124", "2", "100", "0", "NA"]


def test_pivot_identity_is_all_other_columns_and_fill_spares_nulls(spark):
    df = spark.createDataFrame(
        [(1, "g", "a", 1.0), (1, "g", "b", None), (2, "g", "a", 3.0), (1, "h", "b", 4.0)],
        "id int, other string, n string, v double",
    )
    wide = op.pivot_wider(df, "n", "v", ["b", "a"], fill=0.0)
    assert wide.columns == ["id", "other", "b", "a"]
    assert rows(wide) == [(1, "g", None, 1.0), (1, "h", 4.0, 0.0), (2, "g", 0.0, 3.0)]
    assert rows(op.pivot_wider(df, "n", "v", ["b", "a"])) == [(1, "g", None, 1.0), (1, "h", 4.0, None), (2, "g", None, 3.0)]


def test_pivot_cell_with_two_values_fails_or_sums(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id int, n string, v double")
    with pytest.raises(SparkRuntimeException, match="more than one value"):
        op.pivot_wider(df, "n", "v", ["a"]).collect()
    assert rows(op.pivot_wider(df, "n", "v", ["a"], duplicates="sum")) == [(1, 3.0)]


def test_unnest_drops_empty_and_null_arrays(spark):
    df = spark.createDataFrame(
        [(1, [("a", 1.0), ("b", 2.0)]), (2, []), (3, None)], "id int, data array<struct<n:string,v:double>>"
    )
    assert rows(op.unnest(df, "data")) == [(1, "a", 1.0), (1, "b", 2.0)]
    vectors = spark.createDataFrame([(["x", "y"], 1), ([], 2), (None, 3)], "t array<string>, id int")
    assert op.unnest_vector(vectors, "t").columns == ["t", "id"]
    assert rows(op.unnest_vector(vectors, "t")) == [("x", 1), ("y", 1)]


@pytest.mark.parametrize("fill", [None, 0.0])
def test_pivot_in_the_row_equals_unnest_then_pivot(spark, fill):
    df = spark.createDataFrame(
        [
            (1, [("a", 1.0, 9), ("b", None, 9)]),
            (2, [("b", 2.0, 9)]),
            (3, []),
            (4, None),
            (5, [("other", 5.0, 9), ("other", 6.0, 9)]),
            (6, [(None, 5.0, 9), (None, 6.0, 9), ("a", 7.0, 9)]),
        ],
        "id int, data array<struct<n:string,v:double,extra:int>>",
    )
    short = op.pivot_nested(df, "data", "n", "v", ["a", "b"], fill)
    long = op.pivot_wider(op.unnest(df, "data").drop("extra"), "n", "v", ["a", "b"], fill)
    assert short.columns == long.columns
    assert rows(short) == rows(long)
    assert len(rows(short)) == 4


def test_a_name_twice_in_a_row_fails(spark):
    df = spark.createDataFrame([(1, [("a", 1.0), ("a", 2.0)])], "id int, data array<struct<n:string,v:double>>")
    for policy in ("EXCEPTION", "LAST_WIN"):
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        try:
            with pytest.raises(SparkRuntimeException, match="more than one value for 'a'"):
                op.pivot_nested(df, "data", "n", "v", ["a", "b"]).collect()
        finally:
            spark.conf.unset("spark.sql.mapKeyDedupPolicy")
    assert rows(op.pivot_nested(df, "data", "n", "v", ["b"])) == [(1, None)]
    assert rows(op.pivot_nested(df, "data", "n", "v", ["a", "b"], fill=0.0, duplicates="sum")) == [(1, 3.0, 0.0)]
    gaps = spark.createDataFrame([(1, [("a", 1.0), ("a", None), ("b", None)])], df.schema)
    assert rows(op.pivot_nested(gaps, "data", "n", "v", ["a", "b"], duplicates="sum")) == [(1, 1.0, None)]


def test_two_way_choice_stays_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    chosen = df.select(fn.if_else(F.col("x") == 0, F.lit("zero"), F.lit("other")))
    assert [r[0] for r in chosen.collect()] == ["other", "zero", None]


def test_bands_treat_null_as_no_match(spark):
    df = spark.createDataFrame([(0.16, 0), (0.15, 0), (0.08, 0), (0.03, 0), (0.02, 0), (None, 0), (None, 1)], "xg double, p int")
    found = [r[0] for r in df.select(fn.shot_class("xg", penalty=F.col("p"))).collect()]
    assert found == [
        "Above-Average Chance",
        "Average Chance",
        "Average Chance",
        "Below-Average Chance",
        "Poor Chance",
        "Poor Chance",
        "Penalty",
    ]
    top = df.select(fn.shot_class("xg", fn.DISTRIBUTION_CUTS)).collect()
    assert top[1][0] == "Above-Average Chance"
    with pytest.raises(ValueError):
        fn.shot_class("xg", (0.1, 0.2, 0.3))


@pytest.mark.parametrize(
    ("tie", "expected"),
    [("added", (1, 1, None, 2)), ("separate", (1, 1, 1, 1)), ("subtracted", (1, 2, None, 1))],
)
def test_ties_go_where_told(spark, tie, expected):
    df = spark.createDataFrame([(0.1, 0.0), (0.1, 0.05), (0.1, 0.1), (0.1, 0.2)], "xg double, psxg double")
    flags = fn.finishing(tie)
    found = df.agg(*[fn.count_true(c).alias(n) for n, c in flags.items()]).first().asDict()
    names = ("miss_target", "subtr_value", "equal_value", "added_value")
    assert tuple(found.get(n) for n in names) == expected


def test_standard_deviation_of_one_row_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    assert rows(df.groupBy("k").agg(fn.sd("x"))) == [("a", None), ("b", 2.0**0.5)]


def test_line_ignores_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (5.0, 3.0), (None, 4.0), (9.0, None)], "y double, x double")
    line = op.ols(df, "y", "x").first()
    assert (line.intercept, line.slope, line.r_squared, line.n) == (pytest.approx(-1), pytest.approx(2), pytest.approx(1), 3)
    fitted = op.add_fit(df, "y", "x").collect()
    assert sum(r.residual for r in fitted if r.residual is not None) == pytest.approx(0)
    assert fitted[4].fitted is None and fitted[3].residual is None


def test_group_maximum_keeps_ties_and_null_groups(spark):
    day = datetime.date
    df = spark.createDataFrame(
        [
            ("a", day(2023, 1, 1), 1),
            ("a", day(2023, 9, 1), 2),
            ("a", day(2023, 9, 1), 3),
            ("b", day(2022, 1, 1), 4),
            (None, day(2021, 1, 1), 5),
            (None, day(2020, 1, 1), 6),
            ("c", None, 7),
        ],
        "player string, release date, id int",
    )
    kept = op.keep_group_max(df, ["player"], "release")
    assert kept.columns == df.columns
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5]


def test_a_missing_value_hides_its_group_s_maximum(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("b", 3, 3), ("b", 3, 4), (None, 5, 5), ("c", None, 6)], "k string, x int, id int")
    for ties in ("few", "many"):
        assert sorted(r.id for r in op.keep_group_max(df, ["k"], "x", ties=ties).collect()) == [1, 3, 4, 5]
        assert sorted(r.id for r in op.keep_group_max(df, ["k"], "x", "propagate", ties).collect()) == [3, 4, 5]
    for wrong in ({"nulls": "x"}, {"ties": "x"}):
        with pytest.raises(ValueError):
            op.keep_group_max(df, ["k"], "x", **wrong)


def test_unique_keys_can_be_asserted(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, None)], "k int, v string")
    assert rows(op.assert_unique(df, ["k", "v"])) == rows(df)
    repeated = op.assert_unique(df, ["k"])  # nothing runs yet
    with pytest.raises(SparkRuntimeException, match="key is not unique: k=1"):
        repeated.collect()


def test_numbers_in_labels_are_shown_short(spark):
    shown = {
        2.0: "2", 0.1 + 0.2: "0.3", 100000.0: "1e+05", 123456.0: "123456", 150000.0: "150000", 1e-5: "1e-05", 0.0001: "1e-04", 0.00012345: "0.00012345",
        1 / 3: "0.333333333333333", -0.5: "-0.5", 0.0: "0", 1234567.891: "1234567.891", 1e15: "1e+15", 3e100: "3e+100", 1e-300: "1e-300", float("inf"): "Inf",
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(shown)], "k int, x double").orderBy("k")
    assert [r[0] for r in df.select(fn.label("x")).collect()] == list(shown.values())
    mixed = spark.createDataFrame([(1, "2.0", datetime.date(2024, 1, 2), 2.0, None)], "i int, s string, d date, x double, n double")
    assert [r[0] for r in mixed.select(fn.label("i", "s", "d", "x", "n")).collect()] == ["1 2.0 2024-01-02 2 NA"]


def test_names_lose_their_accents():
    assert [snake(x) for x in ("Équipe", "Größe", "Ñandú %", "Tee Direction", "PSxG", "Ødegård")] == ["equipe", "grosse", "nandu_percent", "tee_direction", "p_sx_g", "odegard"]


# Student's quantiles for 0.975 and 0.95 by degrees of freedom.
T_975 = {1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 5: 2.5705818356, 10: 2.2281388520, 30: 2.0422724563, 100: 1.9839715185, 1000: 1.9623390808}
T_95 = {1: 6.3137515147, 2: 2.9199855804, 5: 2.0150483733, 10: 1.8124611228, 30: 1.6972608866, 120: 1.6576508994}


def test_student_quantiles(spark):
    for p, table in ((0.975, T_975), (0.95, T_95)):
        df = spark.createDataFrame([(n,) for n in [0, *table]], "n int")
        found = {r.n: r.t for r in df.select("n", fn.student_t_quantile(p, F.col("n")).alias("t")).collect()}
        assert found.pop(0) is None
        assert found == {n: pytest.approx(t, rel=1e-9) for n, t in table.items()}
    with pytest.raises(ValueError):
        fn.student_t_quantile(1.0, F.lit(3))


def test_confidence_band(spark):
    points = [(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.9), (5.0, 5.1), (6.0, None), (None, 2.0)]
    df = spark.createDataFrame(points, "x double, y double")
    known = [(x, y) for x, y in points if x is not None and y is not None]
    n, mx, my = len(known), sum(x for x, _ in known) / len(known), sum(y for _, y in known) / len(known)
    sxx = sum((x - mx) ** 2 for x, _ in known)
    b = sum((x - mx) * (y - my) for x, y in known) / sxx
    a = my - b * mx
    s = (sum((y - a - b * x) ** 2 for x, y in known) / (n - 2)) ** 0.5
    for row in op.add_fit(df, "y", "x", 0.95).collect():
        if row.x is None:
            assert row.lower is None and row.upper is None
            continue
        half = T_975[3] * s * (1 / n + (row.x - mx) ** 2 / sxx) ** 0.5
        assert (row.lower, row.upper) == (pytest.approx(a + b * row.x - half), pytest.approx(a + b * row.x + half))
    few = op.add_fit(df.limit(2), "y", "x", 0.95).collect()
    assert all(r.lower is None and r.fitted is not None for r in few)


def test_totals_from_one_aggregate(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 6.0)], "k string, g int, x double")
    found = op.totals_by(df, ["k", "g"], {"n": fn.rows(), "m": fn.mean("x")}, {"r": F.col("m") / F.col("n")})
    assert rows(found) == [("Total", "-", 3, 4.0, 4.0 / 3), ("a", "1", 1, 2.0, 2.0), ("a", "2", 1, 4.0, 4.0), (None, "1", 1, 6.0, 6.0)]
    assert rows(op.totals_by(df.limit(0), ["k"], {"n": fn.rows()})) == []


def test_zone_statistics_follow_the_null_rule(spark):
    rows_ = [("A", 1, 1.0, 10.0), ("A", 1, 3.0, 30.0), ("B", 1, 5.0, 20.0), ("A", 2, None, 1.0), ("B", 2, 4.0, None), ("B", 2, 2.0, 3.0)]
    df = spark.createDataFrame(rows_, "team_abbreviation string, zone int, tgaa_96 double, team_goals_added_against double")
    for nulls in ("skip", "propagate"):
        league = {r.zone: r for r in plans.zone_league_average(df, nulls).collect()}
        scores = {(r.team_abbreviation, r.zone): r for r in plans.zone_zscores(df, nulls=nulls).collect()}
        spread = {r.zone: r for r in plans.zone_spread(df, nulls).collect()}
        for (_, zone), r in scores.items():
            assert (r.lg_avg_gaa_96, r.lg_avg_gaa) == (league[zone].lg_avg_gaa_96, league[zone].lg_avg_gaa)
            assert (r.mean_gaa, r.sd_gaa) == (spread[zone].mean_gaa, spread[zone].sd_gaa)
        assert (spread[2].mean_gaa is None) == (spread[2].sd_gaa is None) == (nulls == "propagate")
        assert spread[1].sd_gaa is not None
        assert scores["B", 2].avg_gaa_96 == 3.0 and (scores["B", 2].avg_gaa is None) == (nulls == "propagate")
    with pytest.raises(ValueError):
        plans.zone_spread(df, "other")


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y",)], "b string")
    assert rows(op.union_by_name(a, b, b)) == [(1, "x"), (None, "y"), (None, "y")]
