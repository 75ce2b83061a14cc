"""Labels for the classifiers: which rows may be learnt from, and their join with texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels beyond this number of rows are joined by a shuffle, up to it they are broadcast (ids and a label: 16 MB at most).
MOST_BROADCAST = 1_000_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id has no fold."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, fold) for rows that may be learnt from. Of several labels of one id the highest counts; nulls are none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("fold", fold(F.col("doc_id"))).where("fold != 0")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of ``docs`` with their label and fold; broadcast only where the labels' number is within the bound."""
    small = labels.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.select("doc_id", "text").join(F.broadcast(labels) if small else labels, "doc_id")
