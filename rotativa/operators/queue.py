"""Work queues and health as folds over logs, without row locks: one writer, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import backoff_minutes


def latest_state(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last entry of each key and how many entries it has."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"), F.count("*").alias("intentos")).select(key, "s.*", "intentos")


def failures_in_a_row(log: DataFrame, key: str, ok: Column, *order: str) -> DataFrame:
    """(key, fallos, ultimo_ok): failures since the last success, by two aggregates rather than a sorted group."""
    marked = log.withColumn("__ok", ok).withColumn("__o", F.struct(*order))
    last = marked.where("__ok").groupBy(key).agg(F.max("__o").alias("__last"))
    joined = marked.join(last, key, "left")
    bad = F.count_if(~F.col("__ok") & (F.col("__last").isNull() | (F.col("__o") > F.col("__last"))))
    return joined.groupBy(key).agg(bad.alias("fallos"), F.max("__last")[order[0]].alias("ultimo_ok"))


def claimable(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest entries that are due and unclaimed; one writer marks them."""
    due = F.col("estado").isin("QUEUED", "RETRY") & F.col("reclamado").isNull() & (F.col("proximo").isNull() | (F.col("proximo") <= now))
    return queue.where(due).orderBy("descubierto", "clave").limit(limit)


def after_attempt(queue: DataFrame, results: DataFrame, key: str = "clave") -> DataFrame:
    """The queue after results (key, ok, cuando): done, to be retried after a doubling wait, or blocked."""
    joined = queue.join(results, key, "left")
    n = F.col("intentos") + 1
    wait = backoff_minutes(n)
    tried = F.col("ok").isNotNull()
    state = F.when(~tried, F.col("estado")).when(F.col("ok"), "PERSISTED").when(wait.isNull(), "BLOCKED").otherwise("RETRY")
    again = F.when(~tried, F.col("proximo")).when(~F.col("ok") & wait.isNotNull(), F.timestamp_micros(F.unix_micros("cuando") + wait * 60_000_000))
    cols = {"estado": state, "intentos": F.when(tried, n).otherwise(F.col("intentos")).cast("int"), "proximo": again}
    return joined.select(*(cols[c].alias(c) if c in cols else F.col(c) for c in queue.columns))


def contiguous_windows(df: DataFrame, by: str, day: Column) -> DataFrame:
    """(by, desde, hasta, dias): runs of consecutive days with rows."""
    days = df.select(by, day.alias("d")).where("d IS NOT NULL").distinct()
    run = F.date_sub("d", F.row_number().over(Window.partitionBy(by).orderBy("d")))
    return days.withColumn("r", run).groupBy(by, "r").agg(F.min("d").alias("desde"), F.max("d").alias("hasta"), F.count("*").alias("dias")).drop("r")
