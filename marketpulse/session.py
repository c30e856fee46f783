"""Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "marketpulse", master: str | None = None, shared: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC time.

    Partition counts are left to adaptive execution (it coalesces from
    ``spark.sql.shuffle.partitions``); pass ``**conf`` with dots written as
    ``__`` to override, e.g. ``spark__sql__shuffle__partitions=8``. ``shared`` is
    the folder for intermediate data that all machines see; clusters need one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shared:
        settings["spark.checkpoint.dir"] = shared
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
