"""Incremental processing with Structured Streaming.

Every source can be read as a stream of files; what was processed is the
checkpoint's business, not a flag's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder


def stream_table(spark: SparkSession, data: str, name: str, per_trigger: int = 64) -> DataFrame:
    """A table of a data folder as a stream: of its parts, or of the one file."""
    path = f"{data}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(data)


def run_to_end(stream: DataFrame, mode: str = "append", step: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process all that is there and stop; the result as a table, or what ``step`` made of the batches.

    Results go to files in the shared folder, each batch exactly once.
    """
    spark = stream.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{at}/out"
    if mode == "append" and step is None:
        q = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        def write(batch: DataFrame, number: int) -> None:
            (step or (lambda b, n: b.write.mode("overwrite").parquet(out)))(batch, number)

        q = stream.writeStream.foreachBatch(write).outputMode(mode)
    q.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if step is None else spark.createDataFrame([], stream.schema)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "3 days") -> DataFrame:
    """Rows of a stream without repeats of a key that arrive within a delay."""
    return stream.where(F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, by: list[str], length: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows by window and group."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, delay).groupBy(w, *by).agg(F.count("*").alias("filas")).select(F.col("window.start").alias("desde"), *by, "filas")


def sessions(df: DataFrame, time: str, by: list[str], gap: str = "30 minutes") -> DataFrame:
    """Runs of rows of a group with no gap longer than given; for streams and tables."""
    s = F.session_window(time, gap)
    out = df.withWatermark(time, "1 day") if df.isStreaming else df
    return out.groupBy(*by, s).agg(F.count("*").alias("filas")).select(*by, F.col("session_window.start").alias("desde"), F.col("session_window.end").alias("hasta"), "filas")


def new_only(batch: DataFrame, sink: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch whose key isn't in the sink yet, each key once: late repeats beyond any watermark."""
    return batch.dropDuplicates(keys).join(sink.select(*keys).distinct(), keys, "left_anti")
