"""Incremental staging of arriving files: the batch rule of replay as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import stage


def stage_files(spark: SparkSession, source: str, schema: str, folder: str, key: str, checkpoint: str) -> StreamingQuery:
    """Stages every new JSON-lines file once; a repeated micro-batch adds nothing."""
    rows = spark.readStream.schema(schema).json(source)

    def each(batch: DataFrame, number: int) -> None:
        stage(batch, folder, key, f"batch-{number:08d}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events a window and kind with a watermark; works on streams and on tables."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
