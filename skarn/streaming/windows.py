"""Event-time windows that run alike over tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed(df: DataFrame, time: str, window: str, keys: list[str], aggs: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates for each tumbling (or, with `slide`, sliding) window and keys.
    `late` is the watermark: how long a stream waits for late rows."""
    if late:
        df = df.withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates for each session: rows of a key less than `gap` apart."""
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row a key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now and stop; starts where the last call ended."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
