"""Event streams: windowed aggregates, sessions, bucket thinning and graph edges, with watermarks.

Each function works on static and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, time_col: str, late: str) -> DataFrame:
    rows = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    return rows.withWatermark("_at", late) if events.isStreaming else rows


def window_counts(events: DataFrame, time_col: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum per key and (tumbling or sliding) window; later rows than ``late`` are left out."""
    w = F.window("_at", width, slide) if slide else F.window("_at", width)
    out = _timed(events, time_col, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed after ``gap`` without an event."""
    out = _timed(events, time_col, late).groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def newest_per_bucket(events: DataFrame, time_col: str, keys: list[str], ident: str, width: str, late: str = "1 hour") -> DataFrame:
    """The newest event of each key and bucket."""
    out = _timed(events, time_col, late).groupBy(F.window("_at", width).alias("w"), *keys).agg(F.max(F.struct("_at", ident)).alias("m"))
    return out.select(F.col("w.start").alias("start"), *keys, F.col(f"m.{ident}").alias(ident))


def append_edges(stream: DataFrame, to_edges: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Append the edges of newly arrived rows to a stored graph; each batch has a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        to_edges(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
