"""Session settings for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine relies on; sizes follow the cluster and are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", name: str = "rotativa", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` adds to them."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
