"""Intermediate results kept where every executor can read them.

Lineage is cut by writing to the folder the cluster names in
``spark.checkpoint.dir``; a lost executor then costs no recomputation, and a
result used twice is computed once.  Only a session within one process, as in
tests, may do without that setting: it has a folder of its own then, removed at
the end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of a session; without one a cluster's session is refused."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rotativa-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _kept.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove what a session has kept so far, when no result that reads it is needed any more; the number of results removed."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
