"""Structured Streaming forms of the ingest side: a folder of records, hop windows and an upsert per batch.

The reference has no streaming engine; these are extensions with the batch operators' results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", files: int = 1) -> DataFrame:
    """New files of a folder, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(path)


def hop_counts(events: DataFrame, at: str, kind: str, size: str = "180 seconds", step: str = "170 seconds", late: str | None = None) -> DataFrame:
    """``window_start, window_end, kind, n`` over overlapping windows; ``late`` sets a watermark."""
    df = events.withWatermark(at, late) if late else events
    return (
        df.groupBy(F.window(at, size, step), F.col(kind).alias("kind"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "kind", "n")
    )


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs through all files that are there, a batch at a time; a checkpoint makes a second run resume."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
