"""Computing a shared intermediate once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reuse_point(df: DataFrame) -> DataFrame:
    """Let several uses of an aggregate in one query share its shuffle.

    Spark reuses a shuffle when two branches need exactly the same one, but column
    pruning and filter pushdown usually make them differ: a branch that needs two of
    five sums plans its own scan for the two. Passing the rows through ``inline`` of one
    struct makes every branch ask for all columns, so the input is scanned and shuffled
    once. It changes no value and needs no cache. Put it on aggregated rows only.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors reach.

    Where it is unset, a local session gets a temporary folder of its own and keeps it; on a cluster that raises.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before staging a table")
        found = tempfile.mkdtemp(prefix="courtside-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and continue from the files.

    For a table that several *actions* share (the cleaned shots, say). The files are
    replicated storage, so a lost executor loses nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
