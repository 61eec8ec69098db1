"""Session factory with the settings that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Exact arithmetic errors, deep recursion, TIME values and zone-free timestamps; the optimizer adapts at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.cteRecursionRowLimit": "1000000",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` are further ones, with _ for dots."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
