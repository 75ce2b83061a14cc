"""Random small tables full of nulls and ties: Spark against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from courtside import functions as fn
from courtside import operators as op
from courtside import plans
from oracle_check import difference

KEYS = ["a", "b", "c", None]
NUMBERS = [0.0, 0.25, 0.5, 0.5, 1.0, None]


def _table(rng, columns, n):
    domains = {"k": KEYS, "g": KEYS, "n": ["p", "q", "r", "s"], "x": NUMBERS, "y": NUMBERS, "i": [1, 2, 3, None]}
    return [tuple(rng.choice(domains[c]) for c in columns) for _ in range(n)]


KINDS = {"k": "string", "g": "string", "n": "string", "x": "double", "y": "double", "i": "int"}


@pytest.fixture(params=range(3))
def make(spark, request):
    """Create the same random table on both sides."""
    rng = random.Random(request.param)
    con = duckdb.connect()

    def create(name, columns, n=40):
        data = _table(rng, columns, n)
        spark_kinds = ", ".join(f"{c} {KINDS[c]}" for c in columns)
        con.execute(f"CREATE TABLE {name} ({spark_kinds.replace('string', 'VARCHAR')})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", data)
        return spark.createDataFrame(data, spark_kinds)

    create.con = con
    return create


@pytest.mark.parametrize("how", ["left", "right", "inner"])
@pytest.mark.parametrize(("null_keys", "same"), [("match", "IS NOT DISTINCT FROM"), ("never", "=")])
def test_joins(make, how, null_keys, same):
    left, right = make("l", ["k", "g", "x"]), make("r", ["k", "g", "y"])
    side = "r" if how == "right" else "l"
    sql = f"SELECT {side}.k, {side}.g, x, y FROM l {how.upper()} JOIN r ON l.k {same} r.k AND l.g {same} r.g"
    assert difference(op.join_natural(left, right, how=how, null_keys=null_keys), make.con, sql) is None


def test_group_maximum(make):
    df = make("t", ["k", "g", "x"])
    sql = "SELECT * FROM t QUALIFY t.x = max(t.x) OVER (PARTITION BY k, g)"
    assert difference(op.keep_group_max(df, ["k", "g"], "x"), make.con, sql) is None


@pytest.mark.parametrize("fill", [None, 0.0])
def test_pivot_with_sums(make, fill):
    df = make("t", ["k", "n", "x"])
    cell = "sum(x) FILTER (n = '{0}')"
    if fill is not None:
        cell = "CASE WHEN count(*) FILTER (n = '{0}') = 0 THEN 0.0e0 ELSE " + cell + " END"
    sql = f"SELECT k, {', '.join(cell.format(n) + ' AS ' + n for n in 'pqz')} FROM t GROUP BY k"
    assert difference(op.pivot_wider(df, "n", "x", ["p", "q", "z"], fill, "sum"), make.con, sql) is None


def test_running_share_and_share(make):
    df = make("t", ["x"]).groupBy("x").agg(fn.rows().alias("n"))
    sql = """SELECT x, count(*) AS n,
        sum(count(*)) OVER (ORDER BY x NULLS LAST) / sum(count(*)) OVER () AS cdf FROM t GROUP BY x"""
    assert difference(op.running_share(df, "x", "n", "cdf"), make.con, sql) is None
    sql = "SELECT x, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM t GROUP BY x"
    assert difference(op.share_of_total(df, "n", "pct"), make.con, sql) is None


def test_totals(make):
    df = make("t", ["k", "g", "i"]).groupBy("k", "g").agg(F.sum("i").alias("i"))
    sql = """WITH c AS (SELECT k, g, CAST(sum(i) AS BIGINT) AS i FROM t GROUP BY k, g)
        SELECT * FROM c UNION ALL SELECT 'Total', '-', CAST(sum(i) AS BIGINT) FROM c"""
    assert difference(op.add_totals(df), make.con, sql) is None


@pytest.mark.parametrize("tie", ["added", "separate", "subtracted"])
def test_finishing_counts(make, tie):
    df = make("t", ["k", "x", "y"])
    less, more = ("<=" if tie == "subtracted" else "<"), (">=" if tie == "added" else ">")
    equal = "count(*) FILTER (y <> 0 AND y = x) AS equal_value," if tie == "separate" else ""
    sql = f"""SELECT k, count(*) FILTER (y = 0) AS miss_target, count(*) FILTER (y <> 0 AND y {less} x) AS subtr_value,
        {equal} count(*) FILTER (y <> 0 AND y {more} x) AS added_value FROM t GROUP BY k"""
    flags = fn.finishing(tie, "x", "y")
    counted = df.groupBy("k").agg(*[fn.count_true(c).alias(name) for name, c in flags.items()])
    assert difference(counted, make.con, sql) is None


def test_group_stats(make):
    df = make("t", ["k", "x"])
    sql = "SELECT k, x, avg(x) OVER w AS m, max(x) OVER w AS top FROM t WINDOW w AS (PARTITION BY k)"
    found = op.with_group_stats(df, ["k"], {"m": fn.mean("x"), "top": fn.largest("x")})
    assert difference(found, make.con, sql) is None


@pytest.mark.parametrize("nulls", ["skip", "propagate"])
def test_propagation(make, nulls):
    df = make("t", ["k", "x"], n=12)
    value = "sum(x)" if nulls == "skip" else "CASE WHEN count(*) = count(x) THEN sum(x) END"
    found = df.groupBy("k").agg(fn.total("x", nulls).alias("s"))
    assert difference(found, make.con, f"SELECT k, {value} AS s FROM t GROUP BY k") is None


def test_player_finishing_on_nulls(make, spark):
    """The whole pipeline with missing squads, seasons and xG, against plain SQL."""
    df = make("t", ["k", "g", "i", "x", "y", "n"], n=120).toDF(
        "player", "squad", "season_end_year", "xg", "psxg", "outcome"
    )
    clean = df.withColumns({"country": F.col("squad"), "outcome": F.when(F.col("outcome") == "p", "Goal").otherwise("x")})
    found = plans.player_finishing(clean, min_shots=3, ordered=False).select(
        "player", "squad", "season_end_year", "shots", "goals", "miss_target_avg", "added_value", "added_value_avg"
    )
    sql = """WITH a AS (
        SELECT g, i, count(*) FILTER (y = 0) / count(*) AS m, count(*) FILTER (y <> 0 AND y > x) / count(*) AS v
        FROM t GROUP BY g, i),
      p AS (
        SELECT k, g, i, count(*) AS shots, count(*) FILTER (n = 'p') AS goals,
               count(*) FILTER (y <> 0 AND y > x) AS added FROM t GROUP BY k, g, i HAVING count(*) >= 3)
      SELECT k AS player, p.g AS squad, p.i AS season_end_year, shots, goals,
             round_even(m * shots * 100, 0) / 100 AS miss_target_avg, added AS added_value,
             round_even(v * shots * 100, 0) / 100 AS added_value_avg
      FROM p JOIN a ON p.g IS NOT DISTINCT FROM a.g AND p.i IS NOT DISTINCT FROM a.i"""
    assert difference(found, make.con, sql) is None
