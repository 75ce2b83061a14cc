"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: coalesces small shuffle partitions, splits skewed join
    # partitions and turns a shuffle join into a broadcast join once the real size
    # of a side is known. No operator here hints a broadcast by itself.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Days and times are compared across sources, so the zone is pinned.
    "spark.sql.session.timeZone": "UTC",
}


def session(app_name: str = "courtside", master: str | None = None, **settings: str) -> SparkSession:
    """Build (or get) a session with the settings above; ``settings`` override them.

    Keyword names use ``__`` for the dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
