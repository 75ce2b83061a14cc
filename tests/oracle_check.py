"""Comparing a registered query with its SQL, strictly: names, kinds of types, all rows, exact values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _kind(name: str) -> str:
    """int, float, text, or the name of any other type."""
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "int"
    if name in ("double", "float"):
        return "float"
    return "text" if name in ("string", "varchar") else name


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    found = con.sql(sql)
    sql_names = found.columns
    if sorted(sql_names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} against {sorted(sql_names)}"
    kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    sql_kinds = {name: _kind(str(kind)) for name, kind in zip(sql_names, found.types)}
    wrong = {n: (kinds[n], sql_kinds[n]) for n in kinds if kinds[n] != sql_kinds[n]}
    if wrong:
        return f"types: {wrong}"
    order = sorted(df.columns)
    spark_rows = Counter(tuple(_value(r[c]) for c in order) for r in df.collect())
    at = [sql_names.index(c) for c in order]
    sql_rows = Counter(tuple(_value(r[i]) for i in at) for r in found.fetchall())
    if spark_rows == sql_rows:
        return None
    here, there = list((spark_rows - sql_rows).elements()), list((sql_rows - spark_rows).elements())
    return (
        f"{sum(spark_rows.values())} rows against {sum(sql_rows.values())}; {len(here)} only in Spark, "
        f"{len(there)} only in SQL\n{order}\n{here[:2]}\n{sorted(there, key=str)[:2]}"
    )
