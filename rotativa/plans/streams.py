"""Queries of streams, queues and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queue
from ..sources.shared import folder as shared_folder
from ..sources.tables import table
from ..streaming.streams import new_only, run_to_end, sessions, stream_table, window_counts


def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, counted as a stream."""
    out = run_to_end(window_counts(stream_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]), "complete")
    return out.select(F.date_format("desde", "yyyy-MM-dd").alias("dia"), "event_type", "filas")


def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows by source after dropping repeats from the stream.

    Every batch adds the rows whose key the sink hasn't, however late they come; no key is held as state.
    """
    sink = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    stream = stream_table(spark, folder, "logs_ingesta")
    spark.createDataFrame([], stream.schema).write.parquet(sink)
    run_to_end(stream, step=lambda batch, _: new_only(batch.where("llegada IS NOT NULL"), spark.read.schema(stream.schema).parquet(sink), ["log_id"]).write.mode("append").parquet(sink))
    return spark.read.schema(stream.schema).parquet(sink).groupBy("medio_id").agg(F.count("*").alias("filas"))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: runs of events with gaps below 30 minutes."""
    s = sessions(table(spark, folder, "events"), "ts", ["user_id"])
    return s.groupBy("user_id").agg(F.count("*").alias("sesiones"), F.max("filas").alias("mayor"))


def source_health(spark: SparkSession, folder: str) -> DataFrame:
    """Failures in a row of each source at the end of its log."""
    log = table(spark, folder, "logs_ingesta").where("medio_id IS NOT NULL").select("medio_id", "log_id", "fecha_hora", "nivel").distinct()
    h = queue.failures_in_a_row(log, "medio_id", ~F.lower("nivel").isin("error", "warn", "warning"), "fecha_hora", "log_id")
    return h.select("medio_id", "fallos", F.when(F.col("fallos") >= 5, "caida").when(F.col("fallos") >= 3, "degradada").otherwise("sana").alias("estado"))


def last_log_state(spark: SparkSession, folder: str) -> DataFrame:
    """Last log entry of each source."""
    log = table(spark, folder, "logs_ingesta").where("medio_id IS NOT NULL").select("medio_id", "log_id", "fecha_hora", "accion", "nivel").distinct()
    return queue.latest_state(log, "medio_id", "fecha_hora", "log_id").select("medio_id", "log_id", "accion", "nivel", "intentos")


def capture_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive days with log rows, by source."""
    w = queue.contiguous_windows(table(spark, folder, "logs_ingesta").where("medio_id IS NOT NULL"), "medio_id", F.to_date("fecha_hora"))
    return w.groupBy("medio_id").agg(F.count("*").alias("tramos"), F.max("dias").alias("mayor"), F.min("desde").cast("string").alias("desde"))


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_first_seen, user_sessions, source_health, last_log_state, capture_windows)}

_L = "(SELECT DISTINCT medio_id, log_id, fecha_hora, accion, nivel FROM logs_ingesta WHERE medio_id IS NOT NULL)"
SQL = {
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS dia, event_type, count(*) AS filas FROM events GROUP BY 1, 2",
    "stream_first_seen": "SELECT medio_id, count(*) AS filas FROM (SELECT log_id, any_value(medio_id) AS medio_id FROM logs_ingesta WHERE llegada IS NOT NULL GROUP BY 1) GROUP BY 1",
    "user_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nueva FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT user_id, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s)
  SELECT user_id, count(*) AS sesiones, max(c) AS mayor FROM (SELECT user_id, k, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1""",
    "source_health": f"""WITH l AS (SELECT DISTINCT medio_id, log_id, fecha_hora, lower(nivel) NOT IN ('error', 'warn', 'warning') AS ok FROM {_L}), u AS (SELECT medio_id, max((fecha_hora, log_id)) AS o FROM l WHERE ok GROUP BY 1)
  SELECT medio_id, fallos, CASE WHEN fallos >= 5 THEN 'caida' WHEN fallos >= 3 THEN 'degradada' ELSE 'sana' END AS estado FROM (SELECT medio_id, count_if(NOT ok AND (o IS NULL OR (fecha_hora, log_id) > o)) AS fallos FROM l LEFT JOIN u USING (medio_id) GROUP BY 1)""",
    "last_log_state": f"SELECT medio_id, log_id, accion, nivel, n AS intentos FROM (SELECT *, row_number() OVER (PARTITION BY medio_id ORDER BY fecha_hora DESC, log_id DESC) AS r, count(*) OVER (PARTITION BY medio_id) AS n FROM {_L}) WHERE r = 1",
    "capture_windows": f"""WITH d AS (SELECT DISTINCT medio_id, CAST(fecha_hora AS DATE) AS d FROM {_L}), r AS (SELECT medio_id, d, d - CAST(row_number() OVER (PARTITION BY medio_id ORDER BY d) AS INTEGER) AS g FROM d)
  SELECT medio_id, count(*) AS tramos, max(n) AS mayor, min(a)::VARCHAR AS desde FROM (SELECT medio_id, g, min(d) AS a, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1""",
}
