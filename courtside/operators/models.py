"""Simple least squares as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import student_t_quantile


def _coefficients(y: str, x: str) -> dict[str, Column]:
    return {
        "intercept": F.regr_intercept(y, x),
        "slope": F.regr_slope(y, x),
        "r_squared": F.regr_r2(y, x),
        "n": F.regr_count(y, x),
    }


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row with the line ``y ~ x``: intercept, slope, R squared, pairs used.

    Pairs with a null are left out. One pass with partial aggregation.
    """
    return df.agg(*[c.alias(name) for name, c in _coefficients(y, x).items()])


def add_fit(df: DataFrame, y: str, x: str, level: float | None = None) -> DataFrame:
    """Add the fitted value and the residual of ``y ~ x`` to each row; with ``level`` also the line's confidence band.

    ``lower`` and ``upper`` hold the line at each x with probability ``level``: fitted -/+ t s sqrt(1/n + (x - mean)^2 / Sxx),
    s the residuals' deviation on n - 2 degrees of freedom, t Student's quantile. With under three pairs, or a single x, they
    are null. All of it follows from one set of sums, a one-value subquery, not a join. Reads ``df`` twice, for the line only
    ``y`` and ``x``.
    """
    found = _coefficients(y, x)
    line = F.struct(
        found["intercept"].alias("a"), found["slope"].alias("b"), found["n"].alias("n"), F.regr_avgx(y, x).alias("mean"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    sums = df.agg(line.alias("line"))
    if level is None:
        sums = sums.select(F.struct("line.a", "line.b").alias("line"))
    else:
        freedom = F.col("line.n") - 2
        rest = F.greatest(F.col("line.syy") - F.col("line.b") * F.col("line.sxy"), F.lit(0.0))
        reach = student_t_quantile((1 + level) / 2, freedom) * F.sqrt(F.try_divide(rest, freedom))
        sums = sums.select(F.struct("line.*", reach.alias("reach")).alias("line"))
    one = sums.scalar()
    out = df.withColumn("fitted", one["a"] + one["b"] * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))
    if level is None:
        return out
    away = F.col(x) - one["mean"]
    half = one["reach"] * F.sqrt(F.try_divide(F.lit(1.0), one["n"]) + F.try_divide(away * away, one["sxx"]))
    return out.withColumns({"lower": F.col("fitted") - half, "upper": F.col("fitted") + half})
