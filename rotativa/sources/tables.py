"""Reading the project's tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Clusters install the package on their executors; this serves sessions that
    were started elsewhere than beside it.
    """
    env = getattr(getattr(spark, "sparkContext", None), "environment", None)
    if env is not None and _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; one file or a folder of parts."""
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
