import datetime

import pytest
from pyspark.sql import functions as F

from courtside import plans, sources
from helpers import rows

PARS = [4, 4, 3, 4, 5, 4, 3, 5, 4, 4, 3, 4, 5, 4, 4, 3, 5, 4]


def test_course_handicap_golden(spark):
    """Index 18.3 on a course of slope 115, rating 68.6 and par 72 in conditions worth 3."""
    assert sum(PARS) == 72
    holes = spark.createDataFrame([("r1", h + 1, p) for h, p in enumerate(PARS)], "round_id string, hole int, par int")
    rounds = spark.createDataFrame(
        [("r1", 115, 68.6, 3, 18.3), ("no card", 115, 68.6, 3, 18.3)],
        "round_id string, slope int, rating double, pc_coeff int, handicap_index double",
    )
    found = plans.course_handicap(rounds, holes, how="inner").collect()
    assert [(r.round_id, r.par, r.adjusted_par, r.course_handicap) for r in found] == [("r1", 72, 90, 18)]


def test_adjusted_par_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.0, 113, 70.5, 0), (0.0, 113, 71.5, 1)], "i double, s int, r double, p int")
    assert [r[0] for r in df.select(plans.adjusted_par("i", "s", "r", "p")).collect()] == [70.0, 73.0]


HEADER = (
    "Hole,Par,Yardage,Handicap,Score,Putts,Partials,Fulls,Tee Direction,Drops from Tee,Drops from Approach,"
    "Drop from Partial"
)


def test_scorecards_from_a_folder(spark, tmp_path):
    for name in ("card_a", "card_b"):
        lines = [f"{i + 1},{p},{p * 90},{i + 1},{p + 1},2,0,{p - 1},Hit,0,0,0" for i, p in enumerate(PARS)]
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *lines]))
    cards = sources.scorecards(spark, str(tmp_path))
    assert cards.columns[8:] == "tee_direction drops_from_tee drops_from_approach drop_from_partial round_id".split()
    sums = cards.groupBy("round_id").agg(F.sum("par"), F.sum("score"), F.sum("putts"), F.countDistinct("handicap"))
    assert rows(sums) == [("card_a", 72, 90, 36, 18), ("card_b", 72, 90, 36, 18)]
    balance = F.col("putts") + F.col("partials") + F.col("fulls") + F.col("drops_from_tee")
    assert cards.filter(F.col("score") != balance).count() == 0


def test_rounds_honour_the_zone(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"round_id": "card_a", "course": "Town", "round_datetime": "2024-01-27 09:20:00 EST", "tees": "White",'
        ' "slope": 115, "rating": 68.6, "pc_coeff": 3, "handicap_index": 18.3}'
    )
    found = sources.rounds(spark, str(tmp_path)).selectExpr("CAST(round_datetime AS string) AS at", "slope").first()
    assert found.at == "2024-01-27 14:20:00" and found.slope == 115


@pytest.fixture
def posts(spark):
    day = datetime.date
    return spark.createDataFrame(
        [
            ("On finishing", day(2024, 1, 20), ["soccer", "analytics", "methodology"]),
            ("A round", day(2024, 1, 29), ["golf"]),
        ],
        "title string, date date, categories array<string>",
    )


def test_newest_post_first(spark, posts):
    undated = spark.createDataFrame([("Draft", None, None)], posts.schema)
    found = plans.post_listing(posts.unionByName(undated)).collect()
    assert [r.title for r in found] == ["A round", "On finishing", "Draft"]


def test_category_counts_golden(posts):
    found = rows(plans.category_counts(posts))
    assert found == [("All", 2), ("analytics", 1), ("golf", 1), ("methodology", 1), ("soccer", 1)]


def test_posts_count_once_per_category_and_without_any(spark, posts):
    more = spark.createDataFrame([("a", None, None), ("b", None, ["All", "golf", "golf"])], posts.schema)
    found = rows(plans.category_counts(posts.unionByName(more)))
    assert ("All", 4) in found and ("All", 1) in found and ("golf", 2) in found


def test_category_filter(spark, posts):
    listed = spark.createDataFrame(
        [("x", "golf,soccer"), ("y", "soccer analytics"), ("z", None)], "title string, categories string"
    )
    assert rows(plans.category_filter(listed, "soccer").select("title")) == [("x",)]
    assert plans.category_filter(listed, "").count() == 3
    assert rows(plans.category_filter(posts, "golf").select("title")) == [("A round",)]
    assert rows(plans.category_counts(listed)) == [("All", 3), ("golf", 1), ("soccer", 1), ("soccer analytics", 1)]
