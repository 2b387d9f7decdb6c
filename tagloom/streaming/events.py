"""Event-time operators; each takes a static or a streaming frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, window_end, key, n, total) of tumbling or sliding windows; rows later than ``late`` are dropped by a stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of events less than ``gap`` apart."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """First arrivals of each key within the watermark; a static frame is deduplicated whole."""
    marked = events.withWatermark(ts, late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def sliding_context(chunks: DataFrame, stream: str, order: str, samples: str, left: int = 1, right: int = 1) -> DataFrame:
    """Each chunk with ``left`` chunks before and ``right`` behind it, laid end to end as ``context``."""
    frame = W.partitionBy(stream).orderBy(order).rowsBetween(-left, right)
    return chunks.withColumn("context", F.flatten(F.collect_list(samples).over(frame)))


def token_times(tokens: DataFrame, place: str, stride: float, offset: float = 0.0) -> DataFrame:
    """``time``: place times stride."""
    return tokens.withColumn("time", F.round(F.col(place) * stride + offset, 6))


def resumable(spark: SparkSession, source: str, schema: str, change: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Files as they arrive, through ``change``, to Parquet: what a checkpoint has is not done again, each row lands once."""
    rows = spark.readStream.schema(schema).json(source)
    return change(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
