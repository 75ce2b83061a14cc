"""Listing of posts: newest first, counted and filtered by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import rows
from courtside.operators import arrange

# Fixed value: name of the row that counts every post.
ALL = "All"


def post_listing(posts: DataFrame, by: str = "date", tie: str = "title") -> DataFrame:
    """All posts, latest first; equal dates by ``tie``."""
    return arrange(posts, f"-{by}", tie)


def _categories(posts: DataFrame) -> Column:
    """The categories as an array, from an array or a comma list."""
    if isinstance(posts.schema["categories"].dataType, T.ArrayType):
        return F.col("categories")
    return F.split("categories", ",")


def category_counts(posts: DataFrame) -> DataFrame:
    """Posts per category, and a row ``All`` with the number of posts.

    Each post emits its distinct categories and one marked entry for the total, so one scan and one
    shuffle serve both; the counts are combined before the shuffle, which keeps the total row cheap.
    """
    own = F.transform(
        F.coalesce(F.array_distinct(_categories(posts)), F.array().cast("array<string>")),
        lambda c: F.struct(c.alias("category"), F.lit(False).alias("every")),
    )
    every = F.array(F.struct(F.lit(ALL).alias("category"), F.lit(True).alias("every")))
    return (
        posts.select(F.inline(F.concat(every, own)))
        .groupBy("category", "every")
        .agg(rows().alias("n"))
        .drop("every")
    )


def category_filter(posts: DataFrame, category: str) -> DataFrame:
    """Posts in the category; an empty one means all posts. A post without categories is in none."""
    return posts if category == "" else posts.filter(F.array_contains(_categories(posts), category))
