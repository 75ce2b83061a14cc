"""Readers of landed files.

Each has a declared schema and passes its parameters on as filters of partition columns,
so files outside the choice are never opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import clock_time
from courtside.operators import clean_names
from courtside.operators.columns import snake
from courtside.sources import schemas

#: Values of a column, or a table with one column of them: its rows pick partitions when the query runs.
Choice = str | int | Iterable[str | int] | DataFrame | None

FORMATS = ("parquet", "json", "orc")


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}, not {fmt!r}")
    return spark.read.schema(schema).format(fmt).load(path)


def _among(df: DataFrame, **choices: Choice) -> DataFrame:
    """Keep the chosen values of each column; ``None`` means all.

    Values in the plan prune partitions when it is made. A table of values is joined, and where it is a filtered table Spark
    broadcasts its values to the scan first, so other partitions are not opened either.
    """
    for name, choice in choices.items():
        if isinstance(choice, DataFrame):
            (column,) = choice.columns
            chosen = choice.select(F.col(column).cast(df.schema[name].dataType).alias("__chosen"))
            df = df.join(chosen, F.col(name) == F.col("__chosen"), "left_semi")
        elif choice is not None:
            values = [choice] if isinstance(choice, (str, int)) else list(choice)
            df = df.filter(F.col(name).isin(values))
    return df


def _league(
    df: DataFrame, country: Choice, gender: Choice, tier: Choice, seasons: Choice
) -> DataFrame:
    return _among(df, Country=country, Gender=gender, Tier=tier, Season_End_Year=seasons)


def shots(
    spark: SparkSession,
    path: str,
    country: Choice = None,
    gender: Choice = None,
    tier: Choice = None,
    seasons: Choice = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Shots as delivered, from a table partitioned by country, gender, tier and season."""
    return _league(_load(spark, path, schemas.SHOTS, fmt), country, gender, tier, seasons)


def results(
    spark: SparkSession,
    path: str,
    country: Choice = None,
    gender: Choice = None,
    tier: Choice = None,
    seasons: Choice = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Match results with snake-case names, partitioned like the shots."""
    return clean_names(_league(_load(spark, path, schemas.RESULTS, fmt), country, gender, tier, seasons))


def team_passing(
    spark: SparkSession, path: str, extra: Sequence[T.StructField] = (), rescue: bool = False
) -> DataFrame:
    """Team match statistics from CSV with a header; ``extra`` declares further columns of the file.

    Columns are matched by the header's names, whatever their order in the file. A cell that is not of its column's type is
    null; with ``rescue`` its text stays in ``bad_values``, see :func:`bad_value_counts`.
    """
    wanted = T.StructType([*schemas.TEAM_PASSING.fields, *extra])
    return clean_names(_csv(spark, path, wanted, rescue=rescue))


def scorecards(spark: SparkSession, path: str, rescue: bool = False) -> DataFrame:
    """Hole-by-hole cards, a CSV file per round; ``round_id`` is the file's name without its ending. ``rescue`` as above."""
    cards = _csv(spark, path, schemas.SCORECARD, with_file=True, rescue=rescue)
    name = F.regexp_extract("__file", r"([^/]+?)(\.csv)?$", 1)
    return clean_names(cards.withColumn("round_id", name).drop("__file"))


BAD_VALUES = "bad_values"


def _csv(spark: SparkSession, path: str, schema: T.StructType, with_file: bool = False, rescue: bool = False) -> DataFrame:
    # The reader matches a declared schema by position, so the columns are read as text under the
    # header's names and picked by name: order and further columns do not matter. Every file must
    # have the same header; with enforceSchema off one that differs fails the query.
    text = spark.read.options(header=True, inferSchema=False, enforceSchema=False).csv(path)
    missing = [name for name in schema.fieldNames() if name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    more = [F.col("_metadata.file_path").alias("__file")] if with_file else []
    if rescue:
        bad = [
            F.when(
                (F.trim(f"`{f.name}`") != "") & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(),
                F.struct(F.lit(snake(f.name)).alias("column"), F.col(f"`{f.name}`").alias("text")),
            )
            for f in schema.fields
        ]
        more.append(F.array_compact(F.array(*bad)).alias(BAD_VALUES))
    return text.select(*typed, *more)


def bad_value_counts(read: DataFrame) -> DataFrame:
    """(column, n, example): how many cells of each column could not be read, for a table read with ``rescue``."""
    cells = read.select(F.inline(BAD_VALUES))
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("example"))


def teams(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _load(spark, path, schemas.TEAMS, fmt)


def players(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _load(spark, path, schemas.PLAYERS, fmt)


def player_goals_added(spark: SparkSession, path: str, seasons: Choice = None, fmt: str = "parquet") -> DataFrame:
    """A row per player, team and season with its actions nested."""
    return _seasons(_load(spark, path, schemas.PLAYER_GOALS_ADDED, fmt), seasons)


def goalkeeper_goals_added(spark: SparkSession, path: str, seasons: Choice = None, fmt: str = "parquet") -> DataFrame:
    """As :func:`player_goals_added` for goalkeepers, with all teams of the season in one row."""
    return _seasons(_load(spark, path, schemas.GOALKEEPER_GOALS_ADDED, fmt), seasons)


def team_goals_added(
    spark: SparkSession, path: str, zones: Choice = None, seasons: Choice = None, fmt: str = "parquet"
) -> DataFrame:
    """A row per team, season and pitch zone with its actions nested; partitioned by zone, one scan for all."""
    return _among(_seasons(_load(spark, path, schemas.TEAM_GOALS_ADDED, fmt), seasons), zone=zones)


def salaries(spark: SparkSession, path: str, seasons: Choice = None, fmt: str = "parquet") -> DataFrame:
    """A row per player and release of the salary list."""
    return _among(_load(spark, path, schemas.SALARIES, fmt), season_name=seasons)


def rounds(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A row per round: course, tees, slope, rating, conditions; the time's zone counts."""
    return _load(spark, path, schemas.ROUNDS, fmt).withColumn("round_datetime", clock_time("round_datetime"))


def posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _load(spark, path, schemas.POSTS, fmt)


def _seasons(df: DataFrame, seasons: Choice) -> DataFrame:
    # The season is text in these tables.
    if seasons is None or isinstance(seasons, DataFrame):
        return _among(df, season_name=seasons)
    values = [seasons] if isinstance(seasons, (str, int)) else seasons
    return _among(df, season_name=[str(s) for s in values])
